"""Windows over time, runs, ranks and top-k."""

from pyspark.sql import Window, functions as F

from spreadlake.operators import calendar_ops, panel, ranking
from spreadlake.operators.margin import waterfall
from spreadlake.plans.registry import query


@query("f01_rolling_ratio", "region m:date rolled_ratio:num rolled_denominator:num", """
    select region, m, case when count(imports) over w = 12 and count(intake) over w = 12 then avg(imports) over w / avg(intake) over w end rolled_ratio,
      case when count(intake) over w = 12 then avg(intake) over w end rolled_denominator from runs
    window w as (partition by region order by m rows 11 preceding)""")
def f01(v):
    return panel.rolling_ratio(v.runs, ["region"], "m", "imports", "intake", 12)


@query("f02_latest_complete_window", "region at:date value:num", """
    with r as (select region, m, case when count(imports) over w = 12 then avg(imports) over w / avg(intake) over w end x from runs
      window w as (partition by region order by m rows 11 preceding)) select region, max(m) as at, max_by(x, m) as value from r where x is not null group by 1""")
def f02(v):
    rolled = panel.rolling_ratio(v.runs, ["region"], "m", "imports", "intake", 12)
    return ranking.latest(rolled, ["region"], "m", "rolled_ratio")


@query("f03_lags_before_cut", "region m:date lag1:num lag2:num lag3:num", "select region, m, lag1, lag2, lag3 from lagged")
def f03(v):
    return v.lagged


@query("f04_strict_mean_of_lags", "region m:date margin_lag:num", "select region, m, margin_lag from lagged")
def f04(v):
    return v.lagged


RANKED = """select a.product, a.m, 100.0 * count(case when b.spread <= a.spread then 1 end) / count(b.spread) percentile, count(b.spread) window_obs,
      count(case when b.spread > a.spread then 1 end) + 1 rank_from_top
    from spreads a join spreads b on b.product = a.product and b.m between a.m - interval 35 month and a.m where a.spread is not null group by 1, 2"""


@query("f05_trailing_percentile", "product m:date percentile:num window_obs:int rank_from_top:int", RANKED)
def f05(v):
    return ranking.trailing_rank(v.spreads, ["product"], "m", "spread", months=36).filter("spread is not null")


@query("f06_rank_agreement", "product m:date rank_a:int rank_b:int agree:bool", """
    with a as (select a.product, a.m, count(case when b.spread > a.spread then 1 end) + 1 ra, count(case when b.price > a.price then 1 end) + 1 rb
      from spreads a join spreads b on b.product = a.product and b.m between a.m - interval 35 month and a.m and b.spread is not null
      where a.spread is not null group by 1, 2) select product, m, ra rank_a, rb rank_b, ra = rb agree from a""")
def f06(v):
    rows = v.spreads.filter("spread is not null")
    both = ranking.trailing_rank(ranking.trailing_rank(rows, ["product"], "m", "spread", 36, "a_"), ["product"], "m", "price", 36, "b_")
    return both.select("product", "m", F.col("a_rank_from_top").alias("rank_a"), F.col("b_rank_from_top").alias("rank_b")).withColumn(
        "agree", F.col("rank_a") == F.col("rank_b")
    )


@query("f07_period_changes", "product m:date change:num change_12:num", """
    select product, m, v - lag(v) over w change, v - lag(v, 12) over w change_12 from ruled window w as (partition by product order by m)""")
def f07(v):
    lagged = panel.with_lags(v.ruled, ["product"], "m", "v", (1, 12))
    return lagged.withColumn("change", F.col("v") - F.col("lag1")).withColumn("change_12", F.col("v") - F.col("lag12"))


ISLANDS = """with f as (select product, m, spread > 0 f, row_number() over (partition by product order by m) rn from spreads),
    g as (select product, m, rn - row_number() over (partition by product order by m) g from f where f)"""


@query("f08_runs_of_true", "product first:date last:date length:int", f"""
    {ISLANDS} select product, min(m) as first, max(m) as last, count(*) as length from g group by product, g""")
def f08(v):
    return calendar_ops.runs_of(v.spreads, ["product"], "m", F.col("spread") > 0)


@query("f09_longest_run", "product first:date last:date length:int", """
    with g as (select product, m, year(m) * 12 + month(m) - row_number() over (partition by product order by m) g from spreads where spread > 0 and month(m) <> 7),
    r as (select product, min(m) as first, max(m) as last, count(*) as length from g group by product, g)
    select * from r qualify row_number() over (partition by product order by length desc, first) = 1""")
def f09(v):
    return calendar_ops.longest_run(v.spreads.filter("month(m) <> 7"), ["product"], "m", F.col("spread") > 0)


@query("f10_specification_timeline", "product spec first:date last:date periods:int", """
    with s as (select product, m, case when spread is null then '' when spread > 100 then 'premium' when spread < -100 then 'discount' else 'par' end spec from spreads),
    c as (select *, case when spec is distinct from lag(spec) over (partition by product order by m) then 1 else 0 end c from s where spec <> ''),
    g as (select *, sum(c) over (partition by product order by m) g from c)
    select product, spec, min(m) as first, max(m) as last, count(*) periods from g group by product, g, spec""")
def f10(v):
    spec = F.when(F.col("spread").isNull(), "").when(F.col("spread") > 100, "premium").when(F.col("spread") < -100, "discount").otherwise("par")
    return calendar_ops.value_timeline(v.spreads.withColumn("spec", spec), ["product"], "m", "spec")


@query("f11_gap_clusters", "user_id:int cluster:int first:num last:num members:int centre:num3", """
    with e as (select user_id, epoch(ts) t from events), g as (select *, case when t - lag(t) over (partition by user_id order by t) <= 21600 then 0 else 1 end n from e),
    c as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) cluster from g)
    select user_id, cluster, min(t) as first, max(t) as last, count(*) members, avg(t) centre from c group by 1, 2""")
def f11(v):
    e = v.table("events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return calendar_ops.gap_clusters(e, ["user_id"], "t", 21600.0)


@query("f12_reconstructed_spine", "doc:int position:int date:date", """
    with p as (select doc, date, row_number() over (partition by doc order by date) - 1 as position, count(*) over (partition by doc) n, max(date) over (partition by doc) last
      from (select distinct doc, date from readings)) select doc, position, last - cast(7 * (n - 1 - position) as int) as date from p""")
def f12(v):
    points = v.readings.groupBy("doc", "date").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("doc")
    numbered = (
        points.withColumn("position", F.row_number().over(w.orderBy("date")) - 1)
        .withColumn("n", F.count("*").over(w)).withColumn("last", F.max("date").over(w))
    )
    return calendar_ops.spine_from_last(numbered, F.col("last"), F.col("position"), F.col("n"))


@query("f13_corroboration_bounds", "user_id:int first_corroborated:date last_corroborated:date", """
    with p as (select user_id, cast(ts as date) date, count(distinct length(event_type)) g from events group by 1, 2)
    select user_id, min(case when g > 1 then date end) first_corroborated, max(case when g > 1 then date end) last_corroborated from p group by 1""")
def f13(v):
    e = v.table("events")
    p = e.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.countDistinct(F.length("event_type")).alias("g"))
    return calendar_ops.corroboration_bounds(p, ["user_id"], "date", "g")


ACF = """with c as (select region, m, util - avg(util) over (partition by region) x, row_number() over (partition by region order by m) rn from panel),
    d as (select region, sum(x * x) ss, count(*) n from c group by 1),
    a as (select a.region, a.rn - b.rn as lag, sum(a.x * b.x) s from c a join c b on b.region = a.region and a.rn - b.rn between 1 and 12 group by 1, 2)"""


@query("f14_autocorrelation", "region lag:int acf:num", f"{ACF} select a.region, a.lag, s / ss acf from a join d on d.region = a.region")
def f14(v):
    from spreadlake.operators import threshold

    return threshold.autocorrelation(v.panel, ["region"], "m", "util", 12)


@query("f15_block_length", "region block:int", f"""
    {ACF} select d.region, coalesce(min(case when abs(s / ss) < 2 / sqrt(n) then lag end), 12) as block from a join d on d.region = a.region group by 1""")
def f15(v):
    from spreadlake.operators import threshold

    return threshold.block_length(v.panel, ["region"], "m", "util", 12)


@query("f16_demean_complete_years", "product m:date demeaned:num", """
    select product, m, v - avg(v) over (partition by product, year(m)) demeaned from ruled where v is not null
    qualify count(v) over (partition by product, year(m)) = 12""")
def f16(v):
    from spreadlake.operators import seasonal

    return seasonal.demean_complete_years(v.ruled, ["product"], "m", "v")


@query("f17_waterfall", "m:date product step:int start:num end_:num", """
    with c as (select s.m, s.product, y.yield * s.spread c from spreads s join yields y on y.product = s.product where s.spread is not null)
    select m, product, row_number() over w step, coalesce(sum(c) over w2, 0) start, sum(c) over w end_ from c
    window w as (partition by m order by c desc, product rows unbounded preceding), w2 as (partition by m order by c desc, product rows between unbounded preceding and 1 preceding)""")
def f17(v):
    rows = v.spreads.join(v.yields, "product").withColumn("c", F.col("yield") * F.col("spread")).filter("c is not null")
    return waterfall(rows, ["m"], "product", "c").withColumnRenamed("end", "end_")


@query("g01_carrier", "m:date carrier carrier_value:num", """
    with c as (select s.m, s.product, y.yield * s.spread c from spreads s join yields y on y.product = s.product),
    r as (select *, row_number() over (partition by m order by c desc nulls last, product) r from c)
    select m, case when c is not null then product end carrier, c carrier_value from r where r = 1""")
def g01(v):
    rows = v.spreads.join(v.yields, "product").withColumn("c", F.col("yield") * F.col("spread"))
    return ranking.carrier(rows, ["m"], "product", "c")


@query("g02_ordered_contributions", "m:date rank:int product", """
    select s.m, row_number() over (partition by s.m order by y.yield * s.spread desc, s.product) rank, s.product
    from spreads s join yields y on y.product = s.product where s.spread is not null""")
def g02(v):
    rows = v.spreads.join(v.yields, "product").withColumn("c", F.col("yield") * F.col("spread")).filter("c is not null")
    return ranking.top_k(rows, ["m"], [F.col("c").desc(), "product"], 5)


@query("g03_two_most_negative", "product rank:int m:date spread:num", """
    select product, row_number() over (partition by product order by spread, m) rank, m, spread from spreads where spread is not null
    qualify row_number() over (partition by product order by spread, m) <= 2""")
def g03(v):
    return ranking.top_k(v.spreads.filter("spread is not null"), ["product"], ["spread", "m"], 2)


@query("g04_peak_month", "product at:date value:num", """
    select product, m as at, spread as value from spreads where spread is not null qualify row_number() over (partition by product order by spread desc, m) = 1""")
def g04(v):
    return ranking.extreme(v.spreads.filter("spread is not null"), ["product"], "spread", "m")


@query("g05_latest_observed", "product rank:int m:date v:num", """
    select product, row_number() over (partition by product order by m desc) rank, m, v from ruled where v is not null
    qualify row_number() over (partition by product order by m desc) <= 12""")
def g05(v):
    return ranking.top_k(v.ruled.filter("v is not null"), ["product"], [F.col("m").desc()], 12)


@query("g06_rank_and_gap", "m:date product rank:int gap:num gap_percent:num", """
    select m, product, row_number() over w rank, lead(price) over w - price gap, 100.0 * (lead(price) over w - price) / lead(price) over w gap_percent
    from spreads where price is not null window w as (partition by m order by price, product)""")
def g06(v):
    return ranking.gap_to_second(v.spreads.filter("price is not null"), ["m"], "product", "price")
