"""Event panels and published marts."""

from pyspark.sql import functions as F

from spreadlake.operators import events, margin, panel, regress, threshold
from spreadlake.operators.calendar_ops import longest_run
from spreadlake.plans import q_margin, q_quality, q_regress
from spreadlake.plans.q_joins import EVENT_ROWS, TABLE_WINDOW
from spreadlake.plans.registry import REGISTRY, query

WIN = """(select event_id, day, o as "offset", cast(date_trunc('month', day) + to_months(cast(o as int)) as date) m from event_dim, range(-6, 7) t(o))"""


@query("m01_event_panels", "region event_id offset:int m:date util:num margin:num provisional", f"""
    select r.region, w.event_id, w."offset", w.m, p.util, g.margin, case when p.util is not null then cast(w.m >= date '2001-06-01' as varchar) end provisional
    from (select distinct region from panel) r, {WIN} w left join panel p on p.region = r.region and p.m = w.m left join margins g on g.m = w.m""")
def m01(v):
    series = {
        "util": v.panel.select("region", "m", F.col("util").alias("value")),
        "margin": v.margins.select("m", F.col("margin").alias("value")),
    }
    out = events.panels(v.panel, ["region"], EVENT_ROWS, series)
    flag = F.when(F.col("util").isNotNull(), (F.col("m") >= F.lit("2001-06-01").cast("date")).cast("string"))
    return out.withColumn("provisional", flag)


@query("m01_event_table_panels", "region event_id:int offset:int m:date util:num provisional", f"""
    select w.region, w.event_id, w."offset", w.m, p.util, case when p.util is not null then cast(w.m >= date '2001-06-01' as varchar) end provisional
    from (select * from {TABLE_WINDOW} where region in (select region from panel)) w left join panel p on p.region = w.region and p.m = w.m""")
def m01t(v):
    rows = v.stored_panel
    out = events.panels(rows, ["region"], v.event_table, {"util": rows.select("region", "m", F.col("util").alias("value"))})
    flag = F.when(F.col("util").isNotNull(), (F.col("m") >= F.lit("2001-06-01").cast("date")).cast("string"))
    return out.withColumn("provisional", flag)


@query("m02_event_table_coverage", "region event_id:int present:int before_start:int after_end:int future:int hole:int", f"""
    with h as (select region, m, util from panel where util is not null and month(m) <> 9), sp as (select region, min(m) a, max(m) b from h group by 1),
    j as (select w.region, w.event_id, w.m, a, b, h.util v from {TABLE_WINDOW} w join sp on sp.region = w.region left join h on h.region = w.region and h.m = w.m)
    select region, event_id, count(v) present, count(*) filter (where v is null and m < a) before_start,
      count(*) filter (where v is null and m > b and m <= date '2001-12-01') after_end, count(*) filter (where v is null and m > b and m > date '2001-12-01') future,
      count(*) filter (where v is null and m between a and b) hole from j group by 1, 2""")
def m02t(v):
    s = v.stored_panel.filter(F.month("m") != 9).select("region", "m", F.col("util").alias("value"))
    return events.coverage(s, ["region"], v.event_table, "2001-12-01")


@query("m03_event_table_ranges", "region event_id:int range_start:date range_end:date", """
    with s as (select region, min(m) a, max(m) b from panel where util is not null group by 1)
    select e.region, event_id, greatest(date_trunc('month', day) - interval 6 month, a) range_start, least(date_trunc('month', day) + interval 12 month - interval 1 day, b) range_end
    from s join event_table e on e.region = s.region""")
def m03t(v):
    spans = v.stored_panel.filter("util is not null").groupBy("region").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    return events.named_ranges(spans, v.event_table)


@query("m02_event_coverage", "product event_id present:int before_start:int after_end:int future:int hole:int", f"""
    with h as (select product, m, spread from spreads where spread is not null and not (product = 'LARGE' and month(m) = 9)), sp as (select product, min(m) a, max(m) b from h group by 1),
    j as (select sp.product, w.event_id, w.m, a, b, h.spread v from sp, {WIN} w left join h on h.product = sp.product and h.m = w.m)
    select product, event_id, count(v) present, count(*) filter (where v is null and m < a) before_start,
      count(*) filter (where v is null and m > b and m <= date '2001-12-01') after_end, count(*) filter (where v is null and m > b and m > date '2001-12-01') future,
      count(*) filter (where v is null and m between a and b) hole from j group by 1, 2""")
def m02(v):
    s = v.spreads.filter("not (product = 'LARGE' and month(m) = 9)").select("product", "m", F.col("spread").alias("value"))
    return events.coverage(s, ["product"], EVENT_ROWS, "2001-12-01")


@query("m03_named_ranges", "product event_id range_start:date range_end:date", """
    with s as (select product, min(m) a, max(m) b from spreads where spread is not null group by 1)
    select product, event_id, greatest(date_trunc('month', day) - interval 6 month, a) range_start, least(date_trunc('month', day) + interval 12 month - interval 1 day, b) range_end from s, event_dim""")
def m03(v):
    spans = v.spreads.filter("spread is not null").groupBy("product").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    return events.named_ranges(spans, EVENT_ROWS)


@query("m04_history_mart", "m:date small:num large:num margin:num official:num wedge:num repriced:num disputed:bool", f"""
    with s as (select m, max(case when product = 'SMALL' then spread end) small, max(case when product = 'LARGE' then spread end) large from spreads group by 1)
    select s.m, small, large, g.margin, o.official, (0.21217 - 0.12) * g.bench / 100 wedge, o.official - (0.21217 - 0.12) * g.bench / 100 repriced, coalesce(small > large, false) disputed
    from s left join margins g on g.m = s.m left join {q_margin.OFFICIAL} o on o.m = s.m""")
def m04(v):
    wide = v.spreads.groupBy("m").agg(*[F.max(F.when(F.col("product") == p.upper(), F.col("spread"))).alias(p) for p in ("small", "large")])
    rows = wide.join(v.margins, "m", "left").join(q_margin.official(v), "m", "left").withColumns(margin.gas_wedge(F.col("bench") / 100, 0.12, 0.21217))
    return rows.withColumn("repriced", F.col("official") - F.col("wedge")).withColumn("disputed", F.coalesce(F.col("small") > F.col("large"), F.lit(False)))


@query("m05_runs_mart", "region m:date util:num margin_lag:num source_year:int step_month:bool", """
    with f as (select region, y from (select *, lag(cap) over (partition by region order by y) p from capacity) where cap < p)
    select l.region, l.m, l.util, l.margin_lag, l.source_year, month(l.m) = 1 and f.y is not null step_month from lagged l left join f on f.region = l.region and f.y = year(l.m) - 1""")
def m05(v):
    falls = panel.falls(v.capacity.select("region", "y", F.col("cap").alias("capacity")), ["region"])
    steps = falls.select("region", F.col("y").alias("source_year"), F.lit(True).alias("_fell"))
    return v.lagged.join(steps, ["region", "source_year"], "left").withColumn(
        "step_month", (F.month("m") == 1) & F.col("_fell").isNotNull()
    )


@query("m06_threshold_mart", "region m:date margin_lag:num util:num below:bool in_run:bool", f"""
    with s as (select s.*, tau from {q_regress.SAMPLE} s join {q_regress.POINT} p on p.region = s.region),
    il as (select region, m, year(m) * 12 + month(m) - row_number() over (partition by region order by m) g from s where margin_lag < tau),
    rn as (select region, min(m) a, max(m) b from il group by region, g qualify row_number() over (partition by region order by count(*) desc, min(m)) = 1)
    select s.region, m, margin_lag, util, margin_lag < tau below, coalesce(m between a and b, false) in_run from s left join rn on rn.region = s.region""")
def m06(v):
    rows = q_regress.sample(v)
    point = threshold.search(rows, ["region"], "margin_lag", "util", step=q_regress.STEP).select("region", "tau")
    marked = rows.join(point, "region")
    below = F.col("margin_lag") < F.col("tau")
    run = longest_run(marked, ["region"], "m", below).select("region", F.col("first").alias("a"), F.col("last").alias("b"))
    return marked.join(run, "region", "left").withColumn("below", below).withColumn(
        "in_run", F.coalesce(F.col("m").between(F.col("a"), F.col("b")), F.lit(False))
    )


@query("m07_residual_mart", "region n_post:int positive:int negative:int mean_resid:num", f"""
    with s as (select region, m, util y, margin_lag x from {q_regress.SAMPLE}), f as (select region, regr_slope(y, x) b, regr_intercept(y, x) a from s where m < date '2001-01-01' group by 1)
    select s.region, count(*) n_post, count(*) filter (where y - a - b * x > 0) positive, count(*) filter (where y - a - b * x < 0) negative, avg(y - a - b * x) mean_resid
    from s join f on f.region = s.region where m >= date '2001-01-01' group by 1""")
def m07(v):
    return q_regress.k27(v).groupBy("region").agg(
        F.count("*").alias("n_post"), F.count_if(F.col("resid") > 0).alias("positive"), F.count_if(F.col("resid") < 0).alias("negative"), F.avg("resid").alias("mean_resid")
    )


@query("m08_response_mart", "region term coef:num se:num volume:num4 share:num zero zero_share:num", f"""
    with b as (select region, max_by(capacity, m) base, avg(intake) runs from lagged group by 1),
    t as (select r.region, term, coef, se, coef / 10 * base volume, coef / 10 * base / runs as share,
      (coef - 1.959963984540054 * se) / 10 * base low, (coef + 1.959963984540054 * se) / 10 * base high from {q_regress.CAPACITY_MODEL} r join b on b.region = r.region)
    select *, case when low is null or high is null then null when low <= 0 and high >= 0 then 'includes_zero' when low > 0 then 'above_zero' else 'below_zero' end zero,
      case when low > 0 then 100 * low / (high - low) when high < 0 then 100 * -high / (high - low) end zero_share from t""")
def m08(v):
    """Both response equations' terms translated to volume, with where zero sits in the interval."""
    from spreadlake.functions.numeric import zero_class, zero_share

    base = v.stored_panel.groupBy("region").agg(F.max_by("capacity", "m").alias("base"), F.avg("intake").alias("runs"))
    rows = q_regress.k08c(v).join(base, "region").withColumns(regress.translate("coef", "se", "base", "runs"))
    return rows.withColumn("zero", zero_class("low", "high")).withColumn("zero_share", zero_share("low", "high"))


@query("m08_race_mart", "region candidate rmse:num rank:int verdict", f"""
    with s as (select region, candidate, sqrt(avg(e * e)) rmse from {q_regress.RACE_FORECASTS} group by 1, 2),
    p as (select region, bool_or(distinguishable) d from {q_regress.PAIRS} group by 1)
    select s.region, candidate, rmse, row_number() over (partition by s.region order by rmse, candidate) rank, case when d then 'ordering_informative' else 'cannot_tell_apart' end verdict from s join p on p.region = s.region""")
def m08r(v):
    from spreadlake.operators.ranking import gap_to_second

    forecasts = q_regress.race_forecasts(v)
    scores = regress.forecast_scores(forecasts, ["region", "candidate"], "m")
    told = regress.verdict(scores, regress.loss_differentials(forecasts, ["region"], "m", q_regress.NAMES), ["region"])
    return gap_to_second(scores, ["region"], "candidate", "rmse").join(told.select("region", "verdict"), "region")


@query("m08_instrument_mart", "region first_f:num4 weak:bool sd_inside:num sd_outside:num", f"""
    select a.region, first_f, weak, sd_inside, sd_outside from ({REGISTRY["k24_two_stage_least_squares"].sql}) a
    join ({REGISTRY["k26_instrument_spread"].sql}) b on b.region = a.region""")
def m08i(v):
    return q_regress.k24(v).join(q_regress.k26(v), "region")


@query("m09_provenance_mart", q_quality.PROFILE_COLUMNS + " licence", f"""
    select p.*, case when flow in ('1-URGENT','2-HIGH') then 'open' else 'restricted' end licence from ({q_quality.PROFILE}) p""")
def m09(v):
    registry = v.values("('1-URGENT','open'),('2-HIGH','open'),('3-MEDIUM','restricted'),('4-NOT SPECIFIED','restricted'),('5-LOW','restricted')", "flow, licence")
    return q_quality.profile_frame(v).join(F.broadcast(registry), "flow", "left")
