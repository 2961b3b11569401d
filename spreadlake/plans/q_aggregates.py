"""Aggregations."""

from pyspark.sql import functions as F

from spreadlake.functions import calendar as cal
from spreadlake.operators import aggregates, calendar_ops, panel
from spreadlake.plans.registry import query


@query("e01_period_mean", "product m:date v:num n:int", "select product, m, v, n from ruled")
def e01(v):
    return v.ruled


@query("e01_period_mean_sparse", "o_custkey:int m:date v:num n:int", """
    with a as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) m, avg(o_totalprice) v, count(*) n from orders group by 1, 2),
    s as (select o_custkey, min(m) lo, max(m) hi from a group by 1),
    e as (select o_custkey, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) m from s)
    select e.o_custkey, e.m, case when coalesce(n, 0) >= 2 then v end v, coalesce(n, 0) n from e left join a on a.o_custkey = e.o_custkey and a.m = e.m""")
def e01s(v):
    out = calendar_ops.period_mean(v.table("orders"), ["o_custkey"], "o_orderdate", "o_totalprice", min_obs=2)
    return out.select("o_custkey", F.col("period").alias("m"), F.col("value").alias("v"), F.col("observations").alias("n"))


def _layers(v):
    q = v.quotes
    weekly = q.groupBy("product", cal.anchor("date", "weekly").alias("w")).agg(F.avg("price").alias("p"))
    a = weekly.groupBy("product", cal.month_start("w").alias("m")).agg(F.avg("p").alias("v"))
    return a, v.monthly.select("product", "m", "v")


LAYERS = """w as (select product, date_trunc('week', date) w, avg(price) p from quotes group by 1, 2),
    a as (select product, cast(date_trunc('month', w) as date) m, avg(p) v from w group by 1, 2)"""


@query("e02_layer_overlap", "product periods:int mean_gap:num mean_abs_gap:num corr:num", f"""
    with {LAYERS} select product, count(*) periods, avg(a.v - b.v) mean_gap, avg(abs(a.v - b.v)) mean_abs_gap, corr(a.v, b.v) corr
    from a join monthly b using (product, m) group by 1""")
def e02(v):
    a, b = _layers(v)
    return aggregates.layer_overlap(a, b, ["product"], "m", "v")


AREAS = ["NATION_0", "NATION_5", "NATION_10", "NATION_15", "NATION_20"]


@query("e03_strict_wide_pivot", "flow m:date NATION_0:num2 NATION_5:num2 total:num2 cells:int cells_code_1:int cells_code_2:int cells_code_3:int", """
    with s as (select * from long_stats where area in ('NATION_0','NATION_5','NATION_10','NATION_15','NATION_20')),
    c as (select flow, m, area, sum(v) v, count(v) c from s group by 1, 2, 3),
    w as (select flow, m, max(case when area = 'NATION_0' then v end) "NATION_0", max(case when area = 'NATION_5' then v end) "NATION_5",
      case when count(v) = 5 then sum(v) end total, sum(c) cells from c group by 1, 2),
    k as (select flow, m, count(*) filter (where code = '1') c1, count(*) filter (where code = '2') c2, count(*) filter (where code = '3') c3 from s group by 1, 2),
    sp as (select flow, cast(unnest(generate_series(min(m), max(m), interval 1 month)) as date) m from w group by 1)
    select sp.flow, sp.m, "NATION_0", "NATION_5", total, coalesce(cells, 0) cells, coalesce(c1, 0) cells_code_1, coalesce(c2, 0) cells_code_2, coalesce(c3, 0) cells_code_3
    from sp left join w on w.flow = sp.flow and w.m = sp.m left join k on k.flow = sp.flow and k.m = sp.m""")
def e03(v):
    s = v.long_stats.filter(F.col("area").isin(*AREAS))
    return aggregates.wide_by_area(s, ["flow"], "m", "area", "v", AREAS, "code", ["1", "2", "3"])


EVERY = [f"NATION_{i}" for i in range(25)]
EVERY_CELL = ", ".join(f"max(case when area = '{a}' then v end) \"{a}\"" for a in EVERY)


@query("e03_every_area", "flow m:date " + " ".join(f"{a}:num2" for a in EVERY) + " total:num2 cells:int", f"""
    with c as (select flow, m, area, sum(v) v, count(v) c from long_stats group by 1, 2, 3),
    w as (select flow, m, {EVERY_CELL}, case when count(v) = 25 then sum(v) end total, sum(c) cells from c group by 1, 2),
    sp as (select flow, cast(unnest(generate_series(min(m), max(m), interval 1 month)) as date) m from w group by 1)
    select sp.flow, sp.m, w.* exclude (flow, m, cells), coalesce(cells, 0) cells from sp left join w on w.flow = sp.flow and w.m = sp.m""")
def e03_every(v):
    return aggregates.wide_by_area(v.long_stats, ["flow"], "m", "area", "v", EVERY, "code", ["1", "2", "3"])


@query("e04_flagged_cells", "m:date area flow code", "select m, area, flow, code from long_stats where code = '3'")
def e04(v):
    return aggregates.flagged_cells(v.long_stats, "code", ["3"])


def annual_frame(v):
    annual = v.capacity.select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    monthly = panel.hold_flat(v.runs, annual.filter("y <= 1999"), ["region"])
    return panel.utilisation_annual(monthly, annual, ["region"])


ANNUAL = """(with f as (select r.region, r.m, r.intake, r.imports, l.ly, l.lc, c.cap / 1e6 cap, year(r.m) - 1 sy from runs r
    join (select region, max(y) ly, max_by(cap / 1e6, y) lc, min(y) fy from capacity where y <= 1999 group by 1) l on l.region = r.region
    left join (select * from capacity where y <= 1999) c on c.region = r.region and c.y = year(r.m) - 1 where year(r.m) - 1 >= fy),
   g as (select region, year(m) y, avg(intake) intake, avg(imports) imports, avg(case when sy > ly then lc else cap end) capacity,
     count(intake) as months, bool_or(sy > ly) capacity_assumed from f group by 1, 2)
   select g.*, g.intake / g.capacity utilisation, g.intake / (c.cap / 1e6) utilisation_same_year from g left join capacity c on c.region = g.region and c.y = g.y)"""


@query("e05_annual_utilisation", "region y:int intake:num imports:num capacity:num4 months:int capacity_assumed:bool utilisation:num utilisation_same_year:num",
       f"select * from {ANNUAL}")
def e05(v):
    return annual_frame(v)


@query("e06_expected_vs_observed", "region y:int expected:num difference:num agrees:bool", f"""
    select region, y, round_even(utilisation_same_year, 3) + case when y % 2 = 0 then 0.001 else 0 end expected,
      utilisation_same_year - (round_even(utilisation_same_year, 3) + case when y % 2 = 0 then 0.001 else 0 end) difference, y % 2 = 1 agrees from {ANNUAL}""")
def e06(v):
    a = annual_frame(v)
    shift = F.when(F.col("y") % 2 == 0, F.lit(0.001)).otherwise(F.lit(0.0))
    expected = a.select("region", "y", (F.bround("utilisation_same_year", 3) + shift).alias("expected"))
    return aggregates.expected_vs_observed(a, expected, ["region", "y"], "utilisation_same_year")


@query("e07_year_on_year_falls", "region y:int change:num2", """
    select region, y, cap - p as change from (select *, lag(cap) over (partition by region order by y) p from capacity) where cap < p""")
def e07(v):
    return panel.falls(v.capacity.select("region", "y", F.col("cap").alias("capacity")), ["region"])


@query("e08_implied_ratio", "product periods:int first:date last:date mean:num min:num max:num", f"""
    with {LAYERS} select product, count(*) periods, min(m) as first, max(m) as last, avg(a.v / b.v) mean, min(a.v / b.v) as min, max(a.v / b.v) as max
    from a join monthly b using (product, m) group by 1""")
def e08(v):
    a, b = _layers(v)
    return aggregates.implied_ratio(a, b, ["product"], "m", "v")


@query("e09_ratio_and_comovement", "region months:int first_month:date last_month:date mean_ratio:num min_ratio:num max_ratio:num corr_levels:num corr_12m:num", """
    with d as (select *, imports - lag(imports, 12) over w dn, intake - lag(intake, 12) over w dd from panel where imports is not null window w as (partition by region order by m))
    select region, count(*) as months, min(m) first_month, max(m) last_month, avg(imports / intake) mean_ratio, min(imports / intake) min_ratio,
      max(imports / intake) max_ratio, corr(imports, intake) corr_levels, corr(dn, dd) corr_12m from d group by 1""")
def e09(v):
    return panel.comovement(v.panel, ["region"], "m", "imports", "intake")


@query("e10_lag_correlations", "region regressor lag:int months:int corr_intake:num corr_util:num", """
    with l as (
      select region, intake, util, 0 n, 'margin' r, margin x from panel union all select region, intake, util, 0, 'bench', bench from panel
      union all select region, intake, util, 1, 'margin', lag(margin, 1) over w from panel window w as (partition by region order by m)
      union all select region, intake, util, 1, 'bench', lag(bench, 1) over w from panel window w as (partition by region order by m)
      union all select region, intake, util, 2, 'margin', lag(margin, 2) over w from panel window w as (partition by region order by m)
      union all select region, intake, util, 2, 'bench', lag(bench, 2) over w from panel window w as (partition by region order by m)
      union all select region, intake, util, 3, 'margin', lag(margin, 3) over w from panel window w as (partition by region order by m)
      union all select region, intake, util, 3, 'bench', lag(bench, 3) over w from panel window w as (partition by region order by m))
    select region, r regressor, n as lag, count(*) as months, corr(intake, x) corr_intake, corr(util, x) corr_util from l where x is not null group by 1, 2, 3""")
def e10(v):
    return panel.lag_correlations(v.panel, ["region"], "m", ["margin", "bench"], ["intake", "util"], (0, 1, 2, 3))


@query("e11_r_squared_shared_months", "product r2:num", """
    select a.product, power(corr(a.v, b.v), 2) r2 from ruled a join ruled b on b.m = a.m and b.product = 'STANDARD' where a.product <> 'STANDARD' group by 1""")
def e11(v):
    return v.spreads.groupBy("product").agg(F.pow(F.corr("price", "bench"), 2).alias("r2"))


@query("e13_specification_aware_disagreement", "date:date max_disagreement:num max_respec_gap:num respecified", """
    with s as (select date, field, cast(doc % 3 as varchar) spec, min(value) lo, max(value) hi, count(*) n from readings group by 1, 2, 3),
    t as (select date, field, max(case when n > 1 then hi - lo end) as w_in, case when count(*) > 1 then max(hi) - min(lo) end across,
       string_agg(spec, '|' order by spec) specs from s group by 1, 2)
    select date, max(w_in) max_disagreement, max(across) max_respec_gap,
      coalesce(string_agg(case when across is not null then field || ':' || specs end, ';' order by field), '') respecified from t group by 1""")
def e13(v):
    rows = v.readings.withColumn("spec", (F.col("doc") % 3).cast("string"))
    return aggregates.respecification(rows, ["date"], "field", "spec", "value")


@query("e14_median_across_readings", "doc:int field n:int median:num spread:num", """
    select doc, field, count(*) n, median(value) median, case when count(*) > 1 then max(value) - min(value) end spread from readings group by 1, 2""")
def e14(v):
    return aggregates.readings_summary(v.readings, ["doc", "field"], "value")


@query("e14_quantiles_of_prices", "product p05:num p50:num p95:num", """
    select product, quantile_cont(price, 0.05) p05, quantile_cont(price, 0.5) p50, quantile_cont(price, 0.95) p95 from quotes group by 1""")
def e14q(v):
    return aggregates.exact_quantiles(v.quotes, ["product"], "price", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


ANCHORS = "(select doc, field, value decoded, floor(value) + doc * 0.25 printed from readings)"


def _anchors(v):
    return v.readings.select("doc", "field", F.col("value").alias("decoded"), (F.floor("value") + F.col("doc") * 0.25).alias("printed"))


@query("e15_document_calibration", "doc:int offset:num offset_sd:num anchors:int mae:num worst:num accepted:bool", f"""
    with o as (select doc, avg(printed - decoded) f, stddev_pop(printed - decoded) sd, count(*) n from {ANCHORS} group by 1)
    select o.doc, f as "offset", sd offset_sd, n anchors, avg(abs(decoded + f - printed)) mae, max(abs(decoded + f - printed)) worst,
      max(abs(decoded + f - printed)) <= 0.505 accepted from o join {ANCHORS} a on a.doc = o.doc group by all""")
def e15(v):
    return aggregates.calibrate(_anchors(v), "doc", "decoded", "printed", 0.505)


@query("e16_leave_one_series_out", "doc:int oos_mae:num oos_worst:num", f"""
    with p as (select doc, field, sum(printed - decoded) s, count(*) n from {ANCHORS} group by 1, 2), t as (select doc, sum(s) s, sum(n) n from p group by 1),
    f as (select p.doc, p.field, (t.s - p.s) / (t.n - p.n) f from p join t on t.doc = p.doc)
    select a.doc, avg(abs(decoded + f - printed)) oos_mae, max(abs(decoded + f - printed)) oos_worst from {ANCHORS} a join f on f.doc = a.doc and f.field = a.field group by 1""")
def e16(v):
    return aggregates.leave_one_series_out(_anchors(v), "doc", "field", "decoded", "printed")


@query("e17_axis_line_fit", "doc:int slope:num intercept:num n:int worst_residual:num usable:bool", f"""
    with f as (select doc, regr_slope(printed, decoded) b, regr_intercept(printed, decoded) a, count(*) n from {ANCHORS} group by 1)
    select f.doc, b slope, a intercept, n, max(abs(printed - a - b * decoded)) worst_residual, true usable from f join {ANCHORS} x on x.doc = f.doc group by all""")
def e17(v):
    return aggregates.line_fit(_anchors(v), ["doc"], "decoded", "printed")


@query("e18_range_summaries", "product min:num max:num latest:num mean_gap:num max_gap:num max_gap_at:date", """
    select product, min(spread) as min, max(spread) as max, max_by(spread, m) filter (where spread is not null) latest, avg(bench - spread) mean_gap,
      (array_agg(bench - spread order by abs(bench - spread) desc, m) filter (where bench - spread is not null))[1] max_gap,
      (array_agg(m order by abs(bench - spread) desc, m) filter (where bench - spread is not null))[1] max_gap_at from spreads group by 1""")
def e18(v):
    return aggregates.range_summary(v.spreads, ["product"], "m", "spread", "bench")


@query("e19_specification_list", "product brand first:date position:int", """
    with f as (select p_type product, p_brand brand, min(cast(l_shipdate as date)) as first from lineitem join part on p_partkey = l_partkey group by 1, 2)
    select *, row_number() over (partition by product order by first, brand) as position from f""")
def e19(v):
    line = v.table("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"))
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product"), F.col("p_brand").alias("brand"))
    return aggregates.specification_list(line.join(part, "l_partkey"), ["product"], "brand", "d")


@query("e20_aggregate_only_publication", "region m:date total:num2 members:int", """
    with a as (select region, area, m, sum(v) v from long_stats group by 1, 2, 3)
    select region, m, case when count(v) = 5 then sum(v) end total, count(*) members from a group by 1, 2""")
def e20(v):
    from spreadlake.functions.numeric import strict_sum

    cells = v.long_stats.groupBy("region", "area", "m").agg(F.sum("v").alias("v"))
    return cells.groupBy("region", "m").agg(strict_sum("v", 5).alias("total"), F.count("*").alias("members"))
