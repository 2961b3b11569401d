"""Joins and set operations."""

from pyspark.sql import functions as F

from spreadlake.operators import events, panel, spread
from spreadlake.plans.registry import query

EVENT_ROWS = [("price_war", "1996-03-01"), ("strike", "1998-09-14"), ("cold_snap", "2000-12-20"), ("cut", "2001-10-01")]


def _legs(v):
    window = F.when(F.month("m") == 5, "weekly").otherwise("monthly")
    legs = v.monthly.filter("product <> 'STANDARD'").select("product", F.col("m").alias("date"), window.alias("window"), F.col("v").alias("price"))
    bench = v.monthly.filter("product = 'STANDARD' and month(m) <> 8").select(
        F.col("m").alias("date"), F.lit("monthly").alias("window"), F.col("v").alias("bench")
    )
    return spread.aligned_join(legs, bench, [])


@query("d01_aligned_legs", "product date:date spread:num", """
    select p.product, p.m as date, p.v - b.v spread from monthly p join monthly b on b.m = p.m and b.product = 'STANDARD'
    where p.product <> 'STANDARD' and month(p.m) not in (5, 8)""")
def d01(v):
    return _legs(v)[0].withColumn("spread", F.col("price") - F.col("bench"))


@query("d01_aligned_refusals", "product date:date reason", """
    select p.product, p.m as date, case when b.m is null or month(p.m) = 8 then 'no_benchmark_on_date' else 'window_differs' end reason
    from monthly p left join monthly b on b.m = p.m and b.product = 'STANDARD'
    where p.product <> 'STANDARD' and (month(p.m) in (5, 8) or b.m is null)""")
def d01_bad(v):
    return _legs(v)[1]


@query("d02_left_join_on_period", "m:date margin:num intake:num4", """
    with r as (select m, sum(intake) intake from runs where region <> 'ASIA' group by 1)
    select g.m, g.margin, r.intake from margins g left join r on r.m = g.m""")
def d02(v):
    runs = v.runs.filter("region <> 'ASIA'").groupBy("m").agg(F.sum("intake").alias("intake"))
    return v.margins.join(runs, "m", "left")


@query("d03_runs_margin_panel", "region m:date util:num margin:num", "select region, m, util, margin from panel")
def d03(v):
    return v.panel


@query("d04_multiway_left_join", "region m:date small:num large:num promo:num margin:num", """
    select r.region, r.m, a.spread small, b.spread large, c.spread promo, g.margin from runs r
    left join spreads a on a.m = r.m and a.product = 'SMALL' left join spreads b on b.m = r.m and b.product = 'LARGE'
    left join spreads c on c.m = r.m and c.product = 'PROMO' left join margins g on g.m = r.m""")
def d04(v):
    # the three series share one aggregate: a pivot with explicit values, then one join
    wide = v.spreads.groupBy("m").agg(
        *[F.max(F.when(F.col("product") == p.upper(), F.col("spread"))).alias(p) for p in ("small", "large", "promo")]
    )
    return v.runs.join(wide, "m", "left").join(v.margins.select("m", "margin"), "m", "left")


@query("d05_lagged_year_lookup", "region m:date util:num source_year:int", """
    select r.region, r.m, 1200.0 * r.intake / (c.cap / 1e6) util, c.y source_year
    from runs r join capacity c on c.region = r.region and c.y = year(r.m) - 1""")
def d05(v):
    annual = v.capacity.select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    return panel.utilisation(v.runs, annual, ["region"], 1, 1200.0)


@query("d06_same_year_lookup", "region m:date util:num", """
    select r.region, r.m, 1200.0 * r.intake / (c.cap / 1e6) util from runs r join capacity c on c.region = r.region and c.y = year(r.m)""")
def d06(v):
    annual = v.capacity.select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    return panel.utilisation(v.runs, annual, ["region"], 0, 1200.0)


@query("d07_linear_between_anchors", "region m:date capacity_linear:num", """
    with a as (select region, y, cap / 1e6 c0, lead(y) over w y1, lead(cap / 1e6) over w c1 from capacity window w as (partition by region order by y))
    select r.region, r.m, c0 + date_diff('day', make_date(a.y, 12, 31), r.m) * 1.0 / date_diff('day', make_date(y1, 12, 31 ), make_date(a.y, 12, 31)) * -1 * (c1 - c0) capacity_linear
    from runs r left join a on a.region = r.region and year(r.m) > a.y and year(r.m) <= a.y1""")
def d07(v):
    annual = v.capacity.select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    return panel.linear_between_anchors(v.runs, annual, ["region"])


FLAT = """(select r.region, r.m, year(r.m) - 1 sy, l.ly, c.cap / 1e6 cap, l.lc from runs r
   join (select region, max(y) ly, max_by(cap / 1e6, y) lc, min(y) fy from capacity where y <= 1999 group by 1) l on l.region = r.region
   left join (select * from capacity where y <= 1999) c on c.region = r.region and c.y = year(r.m) - 1 where year(r.m) - 1 >= fy)"""


@query("d08_hold_flat_beyond", "region m:date capacity:num source_year:int capacity_assumed:bool", f"""
    select region, m, case when sy > ly then lc else cap end capacity, case when sy > ly then ly else sy end source_year, sy > ly capacity_assumed from {FLAT}""")
def d08(v):
    annual = v.capacity.filter("y <= 1999").select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    return panel.hold_flat(v.runs, annual, ["region"])


@query("d08_null_beyond", "region m:date capacity:num source_year:num capacity_assumed:bool", f"""
    select region, m, case when sy > ly then null else cap end capacity, case when sy > ly then null else sy end source_year, sy > ly capacity_assumed from {FLAT}""")
def d08n(v):
    annual = v.capacity.filter("y <= 1999").select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    return panel.hold_flat(v.runs, annual, ["region"], beyond="null")


@query("d09_common_sample", "region m:date util:num lag1:num lag2:num lag3:num small:num", """
    select l.region, l.m, l.util, l.lag1, l.lag2, l.lag3, s.spread small from lagged l
    join spreads s on s.product = 'SMALL' and s.m = l.m - interval 1 month
    where l.util is not null and lag1 is not null and lag2 is not null and lag3 is not null and s.spread is not null""")
def d09(v):
    small = panel.with_lags(v.spreads.filter("product = 'SMALL'").select("m", "spread"), [], "m", "spread", (1,), prefix="small")
    rows = v.lagged.join(small.select("m", F.col("small1").alias("small")), "m", "left")
    return panel.common_sample(rows, ["util", "lag1", "lag2", "lag3", "small"])


@query("d10_semi_join_periods", "region n:int", "select region, count(*) n from panel where m in (select m from spreads where product = 'SMALL' and spread > 0) group by 1")
def d10(v):
    keep = v.spreads.filter("product = 'SMALL' and spread > 0").select("m")
    return v.panel.join(keep, "m", "left_semi").groupBy("region").agg(F.count("*").alias("n"))


@query("d10_anti_join_periods", "region n:int", "select region, count(*) n from panel where m not in (select m from spreads where product = 'SMALL' and spread > 0) group by 1")
def d10a(v):
    keep = v.spreads.filter("product = 'SMALL' and spread > 0").select("m")
    return v.panel.join(keep, "m", "left_anti").groupBy("region").agg(F.count("*").alias("n"))


@query("d11_event_windows", "event_id offset:int m:date small:num margin:num", """
    with w as (select event_id, o as "offset", cast(date_trunc('month', day) + to_months(cast(o as int)) as date) m from event_dim, range(-6, 7) t(o))
    select w.event_id, w."offset", w.m, s.spread small, g.margin from w
    left join spreads s on s.m = w.m and s.product = 'SMALL' left join margins g on g.m = w.m""")
def d11(v):
    one = v.values("(0)", "k")
    small = v.spreads.filter("product = 'SMALL'").select("m", F.col("spread").alias("value"))
    return events.panels(one, ["k"], EVENT_ROWS, {"small": small, "margin": v.margins.select("m", F.col("margin").alias("value"))})


@query("d12_rows_in_event_windows", "event_id product n:int mean_price:num", """
    select e.event_id, q.product, count(*) n, avg(q.price) mean_price from quotes q join event_dim e
    on q.date >= date_trunc('month', e.day) - interval 6 month and q.date < date_trunc('month', e.day) + interval 7 month group by 1, 2""")
def d12(v):
    rows = events.in_window(v.quotes, "date", EVENT_ROWS)
    return rows.groupBy("event_id", "product").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"))


TABLE_WINDOW = """(select event_id, region, day, o as "offset", cast(date_trunc('month', day) + to_months(cast(o as int)) as date) m from event_table, range(-6, 7) t(o))"""


@query("d11_event_table_windows", "region event_id:int offset:int m:date util:num margin:num", f"""
    select w.region, w.event_id, w."offset", w.m, p.util, g.margin from (select * from {TABLE_WINDOW} where region in (select region from panel)) w
    left join panel p on p.region = w.region and p.m = w.m left join margins g on g.m = w.m""")
def d11t(v):
    rows = v.stored_panel
    series = {"util": rows.select("region", "m", F.col("util").alias("value")), "margin": v.margins.select("m", F.col("margin").alias("value"))}
    return events.panels(rows, ["region"], v.event_table, series)


@query("d12_totals_in_event_table_windows", "region event_id:int product n:int mean_price:num", f"""
    select e.region, e.event_id, q.product, sum(q.n) n, sum(q.s) / sum(q.n) mean_price from {TABLE_WINDOW} e
    join (select product, cast(date_trunc('month', date) as date) m, count(*) n, sum(price) s from quotes group by 1, 2) q on q.m = e.m group by 1, 2, 3""")
def d12t(v):
    out = events.window_totals(v.quotes, [], "date", "price", v.event_table.withColumn("event_id", F.struct("event_id", "region")), by=["product"])
    return out.select("event_id.region", "event_id.event_id", "product", "n", F.col("mean").alias("mean_price"))


@query("d12_rows_near_table_events", "instrument:int event_id n:int mean_log_price:num first:date last:date", """
    select e.instrument, e.event_id, count(*) n, avg(ln(q.price)) mean_log_price, min(q.date) first, max(q.date) last
    from returns e join quotes q on q.instrument = e.instrument and q.date between e.day - interval 45 day and e.day + interval 45 day group by 1, 2""")
def d12n(v):
    spans = v.returns.withColumn("_from", F.date_sub("day", 45)).withColumn("_to", F.date_add("day", 45))
    rows = events.interval_join(v.quotes, spans, ["instrument"], "date", "_from", "_to")
    return rows.groupBy("instrument", "event_id").agg(
        F.count("*").alias("n"), F.avg(F.ln("price")).alias("mean_log_price"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query("d13_spec_dimension_lookup", "product unit n:int", "select q.product, f.unit, count(*) n from quotes q left join factors f on f.product = q.product group by 1, 2")
def d13(v):
    counts = v.quotes.groupBy("product").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(v.factors), "product", "left")


@query("h01_union_of_extracts", "variant product n:int", """
    select variant, product, count(*) n from (select 'all' variant, product from quotes
      union all select 'accepted', product from quotes where market like 'A%' union all select 'returned', product from quotes where market like 'R%') group by 1, 2""")
def h01(v):
    from spreadlake.operators import regress

    counts = v.quotes.groupBy("product", "market").agg(F.count("*").alias("n"))
    rows = regress.variants(counts, {
        "all": F.lit(True), "accepted": F.col("market").startswith("A"), "returned": F.col("market").startswith("R"),
    })
    return rows.groupBy("variant", "product").agg(F.sum("n").alias("n"))


@query("h03_intersection_of_months", "m:date", """
    select m from spreads where product = 'SMALL' and spread > 0 intersect select m from spreads where product = 'LARGE' and spread > 0""")
def h03(v):
    def months(p):
        return v.spreads.filter(f"product = '{p}' and spread > 0").select("m")

    return months("SMALL").intersect(months("LARGE"))
