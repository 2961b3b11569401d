"""The margin model over the quotes view."""

from pyspark.sql import functions as F

from spreadlake.functions import numeric
from spreadlake.operators import margin, ranking, spread, vintage
from spreadlake.plans.registry import query

# The official margin of a month is made from the tables too: the bench leg over eight, less a seasonal step.
OFFICIAL = "(select m, bench / 8 - month(m) official from margins)"


def slate(v):
    return v.spreads.join(v.yields, "product")


def official(v):
    return v.margins.select("m", (F.col("bench") / 8 - F.month("m")).alias("official"))


def facts(v, gas_div=100.0):
    """Gas, costs and threshold of each month, from the month's own bench leg."""
    return v.margins.select(
        "m", F.lit(1.5).alias("residual"), F.lit(0.2).alias("gas_intensity"), (F.col("bench") / gas_div).alias("gas"),
        F.lit(1.0).alias("other_cost"), F.when(F.month("m") != 4, F.lit(20.0)).alias("threshold"),
    )


SLATE = "(select s.m, s.product, y.yield y, s.spread s, y.yield * s.spread c from spreads s join yields y on y.product = s.product)"
#: The slate that the yields declare.
PRODUCTS = ("ECONOMY", "LARGE", "PROMO", "SMALL", "STANDARD")

EVAL = f"""(select a.m, case when count(c) = (select count(*) from yields) then sum(c) end attributed, sum(y) covered, max(c) best,
   (array_agg(product order by c desc, product) filter (where c is not null))[1] carrier, max(g.bench) / 100 gas,
   case when month(a.m) <> 4 then 20.0 end threshold from {SLATE} a join margins g on g.m = a.m group by a.m)"""


@query("j01_spread_per_barrel", "product m:date spread:num", "select product, m, spread from spreads")
def j01(v):
    return v.spreads


@query("j02_spread_per_tonne", "product m:date usd_bbl:num spread:num", """
    select p.product, p.m, p.v / y.bbl_per_t usd_bbl, p.v / y.bbl_per_t - b.v / 7.55 spread
    from ruled p join yields y on y.product = p.product join ruled b on b.m = p.m and b.product = 'STANDARD'""")
def j02(v):
    tonnes = v.ruled.join(v.yields, "product").withColumn("unit", F.lit("usd_t"))
    legs, _ = spread.convert(tonnes, price="v")
    bench = v.ruled.filter("product = 'STANDARD'").select("m", (F.col("v") / 7.55).alias("bench"))
    return spread.spread(legs, bench, ["m"], "usd_bbl", "bench")


@query("j03_printed_period_spreads", "date:date field spread:num reason", """
    with k as (select *, row_number() over (partition by date, field order by provisional, vintage desc, doc desc) r from readings),
    p as (select date, field, value, provisional from k where r = 1)
    select a.date, a.field, case when not a.provisional and not b.provisional then a.value - b.value end spread,
      case when a.provisional or b.provisional then 'provisional' end reason from p a join p b on b.date = a.date and b.field = 'view' where a.field <> 'view'""")
def j03(v):
    kept = vintage.final_beats_provisional(
        v.readings.filter(~F.col("provisional").isNull()), ["date", "field"], "vintage", "doc", "provisional", ["value"]
    ).select("date", "field", "value", "provisional")
    bench = kept.filter("field = 'view'").select("date", F.col("value").alias("b"), F.col("provisional").alias("bp"))
    rows = kept.filter("field <> 'view'").join(bench, "date")
    open_ = F.col("provisional") | F.col("bp")
    return rows.withColumn("reason", F.when(open_, "provisional")).withColumn("spread", F.when(~open_, F.col("value") - F.col("b")))


def _output(v):
    return v.long_stats.groupBy("region", "m", F.col("flow").alias("product")).agg(F.sum("v").alias("output"))


@query("j04_observed_yields", "region m:date product yield:num yield_total:num share:num basis", """
    with o as (select region, m, flow product, sum(v) output from long_stats group by 1, 2, 3), d as (select region, m, sum(v) d from long_stats group by 1, 2)
    select o.region, o.m, product, output / d as yield, sum(output) over w / d yield_total, output / sum(output) over w as share, 'total_feed' basis
    from o join d on d.m = o.m and d.region = o.region where month(o.m) <> 3 window w as (partition by o.region, o.m)""")
def j04(v):
    den = v.long_stats.groupBy("region", "m").agg(F.sum("v").alias("denominator"))
    den = den.withColumn("denominator", F.when(F.month("m") == 3, 0.0).otherwise(F.col("denominator")))
    return margin.observed_yields(_output(v), den, ["region", "m"], "total_feed")[0]


@query("j04_zero_denominator_refused", "region m:date product reason", """
    select distinct region, m, flow product, 'zero_denominator' reason from long_stats where month(m) = 3""")
def j04_bad(v):
    den = v.long_stats.groupBy("region", "m").agg(F.sum("v").alias("denominator"))
    den = den.withColumn("denominator", F.when(F.month("m") == 3, 0.0).otherwise(F.col("denominator")))
    return margin.observed_yields(_output(v), den, ["region", "m"], "total_feed")[1]


@query("j05_margin_evaluation", "m:date attributed:num gross:num gas_cost:num after_gas:num headroom:num threshold_identified:bool carrier carrier_contribution:num", f"""
    select m, attributed, attributed + 1.5 gross, 0.2 * gas gas_cost, attributed + 1.5 - 0.2 * gas - 1.0 after_gas,
      attributed + 1.5 - 0.2 * gas - 1.0 - threshold headroom, threshold is not null threshold_identified, carrier, best carrier_contribution from {EVAL}""")
def j05(v):
    return margin.evaluate(slate(v), facts(v), ["m"], products=PRODUCTS)


HOLED = """(select w.m, w.product, w.y, case when not (w.product = 'SMALL' and month(w.m) in (2, 3)) then s.spread end s
   from (select m, product, yield y from margins, yields) w left join spreads s on s.m = w.m and s.product = w.product)"""


def holed(v):
    """The slate with the rows of one product gone in February and without its spread in March."""
    rows = slate(v).filter("not (product = 'SMALL' and month(m) = 2)")
    return rows.withColumn("spread", F.when(~((F.col("product") == "SMALL") & (F.month("m") == 3)), F.col("spread")))


@query("j05_incomplete_slate", "m:date attributed:num after_gas:num reason missing", f"""
    with a as (select m, case when count(y * s) = 5 then sum(y * s) end attributed,
      coalesce(string_agg(case when y * s is null then product end, ';' order by product), '') missing from {HOLED} group by 1)
    select a.m, attributed, attributed + 1.5 - 0.2 * bench / 100 - 1.0 after_gas, case when attributed is null then 'slate_incomplete' end reason, missing
    from a join margins g on g.m = a.m""")
def j05_incomplete(v):
    out = margin.evaluate(holed(v), facts(v), ["m"], products=PRODUCTS)
    return out.withColumn("missing", F.array_join("missing", ";"))


@query("j05_basis_refused", "m:date after_gas:num reason", f"""
    select m, case when month(m) % 3 <> 0 then attributed + 1.5 - 0.2 * gas - 1.0 end after_gas,
      case when month(m) % 3 = 0 then 'gas_counted_twice' when attributed is null then 'slate_incomplete' end reason from {EVAL}""")
def j05_basis(v):
    basis = F.when(F.month("m") % 3 == 0, "net_of_gas").otherwise("gross_of_gas")
    return margin.evaluate(slate(v), facts(v).withColumn("margin_basis", basis), ["m"], products=PRODUCTS)


@query("j07_decomposition_of_an_incomplete_slate", "m:date attributed:num residual:num reason", f"""
    with a as (select m, case when count(y * s) = 5 then sum(y * s) end attributed from {HOLED} group by 1)
    select a.m, attributed, official - attributed residual, case when official is null then 'no_official_margin' when attributed is null then 'a_spread_is_missing' end reason from a join {OFFICIAL} o on o.m = a.m""")
def j07_incomplete(v):
    return margin.decompose(holed(v), official(v), ["m"], products=PRODUCTS)


@query("j13_breakeven_without_own_spread", "m:date breakeven_small:num", f"""
    with a as (select m, case when count(y * s) filter (where product <> 'SMALL') = 4 then sum(y * s) filter (where product <> 'SMALL') end others,
      max(y) filter (where product = 'SMALL') y from {HOLED} where month(m) <> 2 group by 1)
    select a.m, (case when month(a.m) <> 4 then 20.0 end + 0.2 * bench / 100 + 1.0 - 1.5 - others) / y breakeven_small from a join margins g on g.m = a.m""")
def j13_own(v):
    out = margin.evaluate(holed(v), facts(v), ["m"], products=PRODUCTS, own="SMALL").filter("month(m) <> 2")
    return out.withColumn("breakeven_small", margin.breakeven_spread())


@query("j06_double_count_guard", "m:date reason", """
    select m, case when month(m) % 3 = 0 and not coalesce(bench / 500 = 0, false) then 'gas_counted_twice' when month(m) = 2 then 'unknown_basis' end reason from margins""")
def j06(v):
    m = F.month("m")
    rows = v.margins.select(
        "m", F.when(m % 3 == 0, "net_of_gas").when(m == 2, "net").otherwise("gross_of_gas").alias("margin_basis"),
        (F.col("bench") / 500).alias("gas_cost"),
    )
    return rows.withColumn("reason", margin.double_count_reason())


@query("j07_official_decomposition", "m:date official:num attributed:num residual:num residual_share:num covered_yield:num", f"""
    select o.m, official, attributed, official - attributed residual, (official - attributed) / nullif(official, 0) residual_share, covered covered_yield
    from {OFFICIAL} o join {EVAL} e on e.m = o.m""")
def j07(v):
    return margin.decompose(slate(v), official(v), ["m"], products=PRODUCTS)


@query("j08_decomposition_history", "m:date residual:num reason", f"""
    select o.m, official - attributed residual, case when official is null then 'no_official_margin' when covered is null then 'no_spreads'
      when attributed is null then 'a_spread_is_missing' end reason
    from {OFFICIAL} o left join (select * from {EVAL} where year(m) >= 1996) e on e.m = o.m""")
def j08(v):
    return margin.decompose(slate(v).filter("year(m) >= 1996"), official(v), ["m"], how="left", products=PRODUCTS)


@query("j09_gas_wedge", "m:date embedded_cost:num study_cost:num wedge:num intensity_ratio:num", """
    select m, 0.12 * bench / 100 embedded_cost, 0.21217 * bench / 100 study_cost, 0.21217 * bench / 100 - 0.12 * bench / 100 wedge, 0.21217 / 0.12 intensity_ratio from margins""")
def j09(v):
    return v.margins.withColumns(margin.gas_wedge(F.col("bench") / 100, 0.12, 0.21217))


@query("j10_repriced_margin", "m:date official:num repriced:num", f"""
    select o.m, official, official - (0.21217 - 0.12) * bench / 100 repriced from {OFFICIAL} o join margins g on g.m = o.m""")
def j10(v):
    rows = official(v).join(v.margins, "m")
    return rows.withColumns(margin.gas_wedge(F.col("bench") / 100, 0.12, 0.21217)).withColumn("repriced", F.col("official") - F.col("wedge"))


@query("j11_fixed_vs_observed_weights", "m:date fixed:num observed:num fixed_residual:num observed_residual:num", f"""
    with q as (select product, m, count(*) n from monthly group by 1, 2), 
    mo as (select product, m, n from monthly where product in ('SMALL','LARGE')), tot as (select m, sum(n) t from monthly group by 1),
    r as (select product, mo.m, avg(n) over w / avg(t) over w y, count(*) over w c from mo join tot on tot.m = mo.m window w as (partition by product order by mo.m rows 11 preceding)),
    s as (select m, max(case when product = 'SMALL' then spread end) a, max(case when product = 'LARGE' then spread end) b from spreads group by 1),
    y as (select m, max(case when product = 'SMALL' and c = 12 then y end) ya, max(case when product = 'LARGE' and c = 12 then y end) yb from r group by 1)
    select s.m, 0.32 * a + 0.12 * b fixed, ya * a + yb * b observed, official - (0.32 * a + 0.12 * b) fixed_residual, official - (ya * a + yb * b) observed_residual
    from s left join y on y.m = s.m left join {OFFICIAL} o on o.m = s.m where a is not null and b is not null""")
def j11(v):
    from spreadlake.operators import panel

    total = v.monthly.groupBy("m").agg(F.sum("n").alias("t"))
    counts = v.monthly.filter(F.col("product").isin("SMALL", "LARGE")).join(total, "m")
    rolled = panel.rolling_ratio(counts, ["product"], "m", "n", "t", 12).select("product", "m", F.col("rolled_ratio").alias("observed_yield"))
    rows = slate(v).filter(F.col("product").isin("SMALL", "LARGE")).join(rolled, ["product", "m"], "left")
    agg = rows.groupBy("m").agg(
        numeric.strict_sum(F.col("yield") * F.col("spread"), 2).alias("fixed"),
        numeric.strict_sum(F.col("observed_yield") * F.col("spread"), 2).alias("observed"),
    ).filter("fixed is not null")
    out = agg.join(official(v), "m", "left")
    return out.withColumn("fixed_residual", F.col("official") - F.col("fixed")).withColumn(
        "observed_residual", F.col("official") - F.col("observed")
    )


@query("j11_weights_of_the_whole_slate", "m:date fixed:num observed:num fixed_residual:num observed_residual:num", f"""
    with tot as (select m, sum(n) t from monthly group by 1),
    r as (select product, mo.m, avg(n) over w / avg(t) over w y, count(*) over w c from monthly mo join tot on tot.m = mo.m window w as (partition by product order by mo.m rows 11 preceding)),
    a as (select s.m, case when count(s.c) = 5 then sum(s.c) end fixed, case when count(case when r.c = 12 then r.y * s.s end) = 5 then sum(case when r.c = 12 then r.y * s.s end) end observed
      from (select m, product, y * s c, s from {HOLED.replace("case when not (w.product = 'SMALL' and month(w.m) in (2, 3)) then s.spread end s", "s.spread s")}) s
      left join r on r.product = s.product and r.m = s.m group by 1)
    select a.m, fixed, observed, official - fixed fixed_residual, official - observed observed_residual from a left join {OFFICIAL} o on o.m = a.m""")
def j11_whole(v):
    from spreadlake.operators import panel

    total = v.monthly.groupBy("m").agg(F.sum("n").alias("t"))
    rolled = panel.rolling_ratio(v.monthly.join(total, "m"), ["product"], "m", "n", "t", 12)
    rolled = rolled.select("product", "m", F.col("rolled_ratio").alias("observed_yield"))
    rows = v.margins.select("m").crossJoin(F.broadcast(v.yields)).join(v.spreads.select("product", "m", "spread"), ["product", "m"], "left").join(rolled, ["product", "m"], "left")
    agg = rows.groupBy("m").agg(
        numeric.strict_sum(F.col("yield") * F.col("spread"), len(PRODUCTS)).alias("fixed"),
        numeric.strict_sum(F.col("observed_yield") * F.col("spread"), len(PRODUCTS)).alias("observed"),
    )
    out = agg.join(official(v), "m", "left")
    return out.withColumn("fixed_residual", F.col("official") - F.col("fixed")).withColumn("observed_residual", F.col("official") - F.col("observed"))


MASS_YIELDS = {"ECONOMY": 0.2, "LARGE": 0.12, "PROMO": 0.08, "SMALL": 0.32}


@query("j12_replication_attempt", "m:date revenue:num covered_mass_yield:num partial:num partial_error:num margin:num within_bar:bool missing", """
    with p as (select * from ruled where not (product = 'PROMO' and month(m) % 2 = 0)),
    mm as (select distinct m from ruled), w as (select m, product, y from mm, (values ('ECONOMY', 0.2), ('LARGE', 0.12), ('PROMO', 0.08), ('SMALL', 0.32)) t(product, y)),
    j as (select w.m, w.product, y, v from w left join p on p.m = w.m and p.product = w.product),
    a as (select m, coalesce(sum(y * v), 0) revenue, coalesce(sum(case when v is not null then y end), 0) covered_mass_yield,
       string_agg(case when v is null then product end, ';' order by product) miss from j group by 1),
    f as (select m, bench / 2 crude, case when month(m) % 3 <> 0 then 12.0 end freight, 5.0 gas, bench / 20 official from margins),
    x as (select a.*, f.*, concat_ws(';', miss, case when freight is null then 'freight' end) missing,
      (revenue - (crude + gas + freight + 0.003 * (crude + freight))) / 7.55 fullm, (revenue - crude * 1.003) / 7.55 "partial" from a join f on f.m = a.m)
    select m, revenue, covered_mass_yield, "partial", "partial" - official partial_error, case when missing = '' then fullm end margin,
      coalesce(missing = '' and abs(fullm - official) <= 0.5, false) within_bar, missing from x""")
def j12(v):
    prices = v.ruled.filter("not (product = 'PROMO' and month(m) % 2 = 0)").select("product", "m", F.col("v").alias("price"))
    f = v.margins.select(
        "m", (F.col("bench") / 2).alias("crude"), F.when(F.month("m") % 3 != 0, F.lit(12.0)).alias("freight"),
        F.lit(5.0).alias("gas_cost"), (F.col("bench") / 20).alias("official"),
    )
    out = margin.replicate(prices, MASS_YIELDS, f, ["m"], 7.55)
    return out.withColumn("missing", F.array_join("missing", ";"))


@query("j13_breakevens", "m:date breakeven_gas:num breakeven_ttf:num breakeven_small:num", f"""
    with s as (select m, y, s from {SLATE} where product = 'SMALL')
    select e.m, (attributed + 1.5 - 1.0 - threshold) / 0.2 breakeven_gas,
      case when month(e.m) <= 6 then (attributed + 1.5 - 1.0 - threshold) * 3.412141633 / (0.2 * 1.1) end breakeven_ttf,
      (threshold + 0.2 * gas + 1.0 - 1.5 - (attributed - s.y * s.s)) / s.y breakeven_small from {EVAL} e join s on s.m = e.m""")
def j13(v):
    out = margin.evaluate(slate(v), facts(v), ["m"], products=PRODUCTS, own="SMALL")
    out = out.withColumn("margin_basis", F.lit("gross_of_gas")).withColumn("eurusd", F.lit(1.1))
    out = out.withColumn("gas_basis", F.when(F.month("m") <= 6, "ttf").otherwise("published"))
    return out.withColumn("breakeven_gas", margin.breakeven_gas()).withColumn("breakeven_ttf", margin.breakeven_ttf()).withColumn(
        "breakeven_small", margin.breakeven_spread()
    )


def bundle(v):
    out = margin.evaluate(slate(v), facts(v), ["m"], products=PRODUCTS).withColumn("margin_basis", F.lit("gross_of_gas"))
    out = out.withColumn("breakeven_gas", margin.breakeven_gas())
    return ranking.trailing_rank(out, [], "m", "after_gas", 120)


@query("j14_output_bundle", "m:date after_gas:num carrier breakeven_gas:num headroom:num percentile:num window_obs:int", f"""
    with e as (select m, attributed + 1.5 - 0.2 * gas - 1.0 after_gas, carrier, (attributed + 1.5 - 1.0 - threshold) / 0.2 breakeven_gas,
      attributed + 1.5 - 0.2 * gas - 1.0 - threshold headroom from {EVAL})
    select a.m, a.after_gas, a.carrier, a.breakeven_gas, a.headroom, case when a.after_gas is not null then 100.0 * count(case when b.after_gas <= a.after_gas then 1 end) / count(b.after_gas) end percentile, count(b.after_gas) window_obs
    from e a join e b on b.m between a.m - interval 119 month and a.m group by a.m, a.after_gas, a.carrier, a.breakeven_gas, a.headroom""")
def j14(v):
    return bundle(v)


@query("j15_fuel_switch", "m:date gas_cost:num fuel_cost:num gap:num variant_gap:num", """
    with p as (select m, max(case when product = 'SMALL' then v end) a, max(case when product = 'PROMO' then v end) b, max(case when product = 'STANDARD' then v end) c from ruled group by 1)
    select m, 0.21217 * c / 100 gas_cost, 0.21217 * a / 6.287 fuel_cost, 0.21217 * c / 100 - 0.21217 * a / 6.287 gap, 0.21217 * c / 100 - 0.21217 * b / 6.287 variant_gap from p""")
def j15(v):
    p = v.ruled.groupBy("m").agg(*[F.max(F.when(F.col("product") == n, F.col("v"))).alias(n) for n in ("SMALL", "PROMO", "STANDARD")])
    gas = F.col("STANDARD") / 100
    variant = margin.fuel_switch(gas, F.col("PROMO"), 6.287, 0.21217)["gap"]
    return p.withColumns(margin.fuel_switch(gas, F.col("SMALL"), 6.287, 0.21217)).withColumn("variant_gap", variant)


@query("j16_latest_view", "product spread_at:date spread:num price_at:date price:num count_at:date n:int", """
    select r.product, max(case when spread is not null then r.m end) spread_at, max_by(spread, r.m) filter (where spread is not null) spread,
      max(case when r.v is not null then r.m end) price_at, max_by(r.v, r.m) filter (where r.v is not null) price, max(r.m) count_at, max_by(r.n, r.m) n
    from ruled r left join spreads s on s.product = r.product and s.m = r.m where r.product <> 'STANDARD' group by 1""")
def j16(v):
    rows = v.ruled.filter("product <> 'STANDARD'").join(v.spreads.select("product", "m", "spread"), ["product", "m"], "left")

    def at(c):
        return F.when(F.col(c).isNotNull(), F.col("m"))

    return rows.groupBy("product").agg(
        F.max(at("spread")).alias("spread_at"), F.max_by("spread", at("spread")).alias("spread"),
        F.max(at("v")).alias("price_at"), F.max_by("v", at("v")).alias("price"),
        F.max("m").alias("count_at"), F.max_by("n", "m").alias("n"),
    )


WATERFALL = f"""(with s as (select m, product, c, count(c) over (partition by m) k from {SLATE}),
    c as (select m, product, c from s where k = 5),
    p as (select m, row_number() over w step, product as label, sum(c) over w - c start, sum(c) over w end_ from c window w as (partition by m order by c desc, product rows unbounded preceding)),
    t as (select m, max(step) n, max_by(end_, step) total from p group by 1), o as (select o.m, official, (0.21217 - 0.12) * bench / 100 wedge from {OFFICIAL} o join margins g on g.m = o.m)
    select m, step, label, start, end_ from p union all select t.m, n + 1, 'residual', total, official from t join o on o.m = t.m
    union all select t.m, n + 2, 'official', 0, official from t join o on o.m = t.m
    union all select t.m, n + 3, 'wedge', official, official - wedge from t join o on o.m = t.m
    union all select t.m, n + 4, 'repriced', 0, official - wedge from t join o on o.m = t.m)"""


@query("j17_waterfall_table", "m:date step:int label start:num end_:num", f"select * from {WATERFALL}")
def j17(v):
    return waterfall_table(v)


@query("j17_waterfall_refusals", "m:date legs:int missing", f"""
    with a as (select m, y.product from (select distinct m from spreads) d, yields y)
    select a.m, count(s.c) legs, string_agg(case when s.c is null then a.product end, ';' order by a.product) missing
    from a left join {SLATE} s on s.m = a.m and s.product = a.product group by 1 having count(s.c) < 5""")
def j17_refusals(v):
    return margin.incomplete_slates(priced(v), ["m"], "product", "c", PRODUCTS).withColumn("missing", F.array_join("missing", ";"))


def priced(v):
    return slate(v).withColumn("c", F.col("yield") * F.col("spread"))


def waterfall_table(v):
    rows = margin.complete_slates(priced(v), ["m"], "product", "c", PRODUCTS)
    steps = margin.waterfall(rows, ["m"], "product", "c")
    total = steps.groupBy("m").agg(F.max("step").alias("n"), F.max_by("end", "step").alias("total"))
    tail = total.join(official(v).join(v.margins.select("m", "bench"), "m"), "m").withColumn("wedge", F.col("bench") / 100 * (0.21217 - 0.12))
    o, w = F.col("official"), F.col("wedge")
    lines = [("residual", F.col("total"), o), ("official", F.lit(0.0), o), ("wedge", o, o - w), ("repriced", F.lit(0.0), o - w)]
    items = F.array(*[F.struct((F.col("n") + i + 1).alias("step"), F.lit(name).alias("label"), s.alias("start"), e.alias("end_")) for i, (name, s, e) in enumerate(lines)])
    head = steps.select("m", "step", F.col("product").alias("label"), "start", F.col("end").alias("end_"))
    return head.unionByName(tail.select("m", F.inline(items)))


PRODUCTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


def scenario_inputs(v):
    wide = slate(v).groupBy("m").agg(
        *[F.max(F.when(F.col("product") == p, F.col("yield"))).alias(f"y_{p}") for p in PRODUCTS],
        *[F.max(F.when(F.col("product") == p, F.col("spread"))).alias(f"s_{p}") for p in PRODUCTS],
    )
    gas = v.margins.select(
        "m", (F.col("bench") / 40).alias("ttf"), F.lit(1.1).alias("eurusd"), F.lit(0.2).alias("gas_intensity"), F.lit(1.0).alias("other_cost")
    )
    return wide.join(gas, "m").join(official(v), "m")


@query("j18_scenario_grid", "scenario m:date excluded blocked_by attributed:num after_gas:num breakeven_gas:num breakeven_ttf:num breakeven_spread:num residual:num carrier", f"""
    with w as (select m, max(case when product='ECONOMY' then c end) e, max(case when product='LARGE' then c end) l, max(case when product='MEDIUM' then c end) d,
       max(case when product='PROMO' then c end) p, max(case when product='SMALL' then c end) s from {SLATE} group by 1),
    b as (select w.*, g.bench / 40 ttf, 1.1 fx, 0.2 gi, 1.0 oc, o.official from w join margins g on g.m = w.m join {OFFICIAL} o on o.m = w.m),
    g as (select 'base' scenario, m, e, l, d, p, s, 1.0 k, ttf, fx, gi, oc, official from b
      union all select 'ttf_doubled', m, e, l, d, p, s, 1, ttf * 2, fx, gi, oc, official from b
      union all select 'large_cleared', m, e, null, d, p, s, 1, ttf, fx, gi, oc, official from b
      union all select 'ttf_cleared', m, e, l, d, p, s, 1, null, fx, gi, oc, official from b
      union all select 'yields_doubled', m, e * 2, l * 2, d * 2, p * 2, s * 2, 2, ttf, fx, gi, oc, official from b
      union all select 'negative_intensity', m, e, l, d, p, s, 1, ttf, fx, -gi, oc, official from b
      union all select 'eurusd_zero', m, e, l, d, p, s, 1, ttf, 0, gi, oc, official from b
      union all select 'small_cleared', m, e, l, d, p, null, 1, ttf, fx, gi, oc, official from b),
    a as (select *, coalesce(e,0)+coalesce(l,0)+coalesce(d,0)+coalesce(p,0)+coalesce(s,0) attributed,
      concat_ws(';', case when e is null then 'ECONOMY' end, case when l is null then 'LARGE' end, case when d is null then 'MEDIUM' end, case when p is null then 'PROMO' end, case when s is null then 'SMALL' end) excluded,
      case when ttf is null then 'ttf' else '' end blocked_by, greatest(e, l, d, p, s) best from g)
    select scenario, m, excluded, blocked_by, attributed, attributed - gi * ttf * fx / 3.412141633 - oc after_gas,
      case when ttf is not null then (attributed - oc - 20) / nullif(gi, 0) end breakeven_gas,
      case when ttf is not null then (attributed - oc - 20) * 3.412141633 / nullif(gi * fx, 0) end breakeven_ttf,
      case when ttf is not null and s is not null then (20 + gi * ttf * fx / 3.412141633 + oc - (attributed - s)) / (0.32 * k) end breakeven_spread,
      official - attributed residual,
      case when e = best then 'ECONOMY' when l = best then 'LARGE' when d = best then 'MEDIUM' when p = best then 'PROMO' when s = best then 'SMALL' end carrier from a""")
def j18(v):
    null = F.lit(None).cast("double")
    grid = margin.scenario_grid(scenario_inputs(v), {
        "base": {},
        "ttf_doubled": {"ttf": F.col("ttf") * 2},
        "large_cleared": {"s_LARGE": null},
        "ttf_cleared": {"ttf": null},
        "yields_doubled": {f"y_{p}": F.col(f"y_{p}") * 2 for p in PRODUCTS},
        "negative_intensity": {"gas_intensity": -F.col("gas_intensity")},
        "eurusd_zero": {"eurusd": F.lit(0.0)},
        "small_cleared": {"s_SMALL": null},
    })
    out = margin.compute_model(grid, PRODUCTS, 20.0, "SMALL")
    return out.withColumn("excluded", F.array_join("excluded", ";")).withColumn("blocked_by", F.array_join("blocked_by", ";"))


@query("j19_strict_presets", "product year:int value:num months_used:int missing_months", """
    with w as (select product, year(m) as year, cast(unnest(generate_series(make_date(year(m), 1, 1), make_date(year(m), 12, 1), interval 1 month)) as date) m from (select distinct product, date_trunc('year', m) m from spreads))
    select w.product, w.year, case when count(s.spread) = 12 then avg(s.spread) end as value, count(s.spread) months_used,
      coalesce(string_agg(case when s.spread is null then strftime(w.m, '%Y-%m') end, ';' order by w.m), '') missing_months
    from w left join spreads s on s.product = w.product and s.m = w.m group by 1, 2""")
def j19(v):
    years = v.spreads.groupBy("product", F.year("m").alias("year")).agg(F.count("*").alias("_n"))
    months = F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(1)), F.expr("interval 1 month"))
    wanted = years.select("product", "year", F.explode(months).alias("m"))
    data = v.spreads.select("product", F.year("m").alias("year"), "m", "spread")
    out = margin.strict_preset(data, wanted, ["product", "year"], "m", "spread")
    return out.withColumn("missing_months", F.array_join("missing_months", ";"))
