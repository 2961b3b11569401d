"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from spreadlake.functions import calendar as cal, numeric, text
from spreadlake.operators import panel, spread
from spreadlake.operators.margin import MMBTU_PER_MWH
from spreadlake.plans.registry import query



@query("c01_unit_conversion", "product m:date usd_bbl:num", """
    select m.product, m.m, case when f.unit = 'usd_t' then v / f.bbl_per_t else v end usd_bbl
    from monthly m join factors f on f.product = m.product
    where not (f.unit = 'usd_bbl' and f.bbl_per_t is not null) and not (f.unit = 'usd_t' and f.bbl_per_t is null)""")
def c01(v):
    return spread.convert(v.monthly.join(v.factors, "product"), price="v")[0]


@query("c01_unit_refusals", "product reason n:int", """
    select m.product, case when f.unit = 'usd_bbl' then 'factor_on_per_barrel_price' else 'factor_missing' end reason, count(*) n
    from monthly m join factors f on f.product = m.product
    where (f.unit = 'usd_bbl' and f.bbl_per_t is not null) or (f.unit = 'usd_t' and f.bbl_per_t is null) group by 1, 2""")
def c01_bad(v):
    return spread.convert(v.monthly.join(v.factors, "product"), price="v")[1].groupBy("product", "reason").agg(F.count("*").alias("n"))


@query("c02_quote_validity", "reason n:int", """
    select case when o_orderkey % 31 = 0 then 'bad_unit' when o_orderkey % 37 = 0 then 'bad_window'
      when o_orderkey % 41 = 0 then 'bad_date' when o_orderkey % 43 = 0 then 'not_a_number' end reason, count(*) n from orders group by 1""")
def c02(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(
        F.when(k % 31 == 0, "eur_t").otherwise("usd_bbl").alias("unit"),
        F.when(k % 37 == 0, "hourly").otherwise("daily").alias("window"),
        F.when(k % 41 == 0, "1999-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(k % 43 == 0, "true").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
    )
    return rows.withColumn("reason", spread.quote_reason("value", "unit", "window", "date")).groupBy("reason").agg(F.count("*").alias("n"))


@query("c03_mass_to_volume_yield", "product volume_yield:num", "select product, yield * bbl_per_t / 7.55 volume_yield from yields join (select distinct product from monthly) using (product)")
def c03(v):
    y = v.yields.join(v.monthly.select("product").distinct(), "product").withColumn("crude", F.lit(7.55))
    return y.withColumn("volume_yield", spread.mass_to_volume_yield("yield", "bbl_per_t", "crude"))


@query("c04_gas_price_paths", "m:date gas_usd_mmbtu:num back_eur_mwh:num basis", f"""
    select m, case when month(m) <= 6 then margin / 40 * 1.1 / {MMBTU_PER_MWH} else bench / 100 end gas_usd_mmbtu,
      case when month(m) <= 6 then margin / 40 end back_eur_mwh, case when month(m) <= 6 and margin is not null then 'ttf' when month(m) > 6 and bench is not null then 'published' end basis
    from margins""")
def c04(v):
    from spreadlake.operators import margin as mg

    ttf = F.when(F.month("m") <= 6, F.col("margin") / 40)
    rows = v.margins.withColumn("ttf", ttf).withColumn("published", F.when(F.month("m") > 6, F.col("bench") / 100))
    gas = mg.gas_price("ttf", F.lit(1.1), "published")
    rows = rows.withColumn("gas_usd_mmbtu", gas).withColumn("basis", mg.gas_basis("ttf", F.lit(1.1), "published"))
    back = F.when(F.col("basis") == "ttf", mg.ttf_of_gas("gas_usd_mmbtu", F.lit(1.1)))
    return rows.withColumn("back_eur_mwh", back)


@query("c05_intensity_from_facts", "region intensity:num", """
    with f as (select region, sum(case when flow = '1-URGENT' then v end) gas, sum(case when flow = '2-HIGH' then v end) heat,
      sum(case when flow = '3-MEDIUM' then v end) steam, sum(v) runs from long_stats group by 1)
    select region, (gas * 1.037 + heat * 0.5 + steam * 0.25) / runs intensity from f""")
def c05(v):
    from spreadlake.operators import margin as mg

    facts = v.long_stats.groupBy("region").pivot("flow", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.sum("v"))
    runs = v.long_stats.groupBy("region").agg(F.sum("v").alias("runs"))
    rows = facts.join(runs, "region")
    return rows.withColumn("intensity", mg.intensity([("1-URGENT", 1.037), ("2-HIGH", 0.5), ("3-MEDIUM", 0.25)], "runs"))


@query("c06_date_labels", "label iso floor:date n:int", """
    select strftime(o_orderdate, '%Y-%m') as label, strftime(o_orderdate, '%Y-%m-%d') iso, date_trunc('month', o_orderdate) as floor, count(*) n
    from orders group by all""")
def c06(v):
    d = F.col("o_orderdate")
    return v.table("orders").groupBy(
        cal.month_label(d).alias("label"), cal.iso_date(d).alias("iso"), cal.month_start(d).alias("floor")
    ).agg(F.count("*").alias("n"))


@query("c07_iso_week", "iso_year:int iso_week:int n:int",
       "select isoyear(o_orderdate) iso_year, week(o_orderdate) iso_week, count(*) n from orders group by 1, 2")
def c07(v):
    return v.table("orders").groupBy(
        cal.iso_year("o_orderdate").alias("iso_year"), cal.iso_week("o_orderdate").alias("iso_week")
    ).agg(F.count("*").alias("n"))


# French month abbreviations as printed, in calendar order.
FRENCH_PRINTED = ["janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."]


@query("c08_french_dates", "parsed:date month:date n:int", """
    select case when o_orderkey % 50 = 0 then null else cast(o_orderdate as date) + interval 20 year end parsed,
      case when o_orderkey % 50 = 0 then null else date_trunc('month', o_orderdate + interval 20 year) end as month, count(*) n
    from orders group by 1, 2""")
def c08(v):
    d = F.add_months(F.to_date("o_orderdate"), 240)
    name = F.element_at(F.array(*[F.lit(m) for m in FRENCH_PRINTED]), F.month(d))
    name = F.when(F.col("o_orderkey") % 50 == 0, "brumaire").otherwise(name)
    yy = F.date_format(d, "yy")
    rows = v.table("orders").select(
        F.concat_ws("-", F.dayofmonth(d).cast("string"), name, yy).alias("printed"), F.concat_ws("-", name, yy).alias("column")
    )
    return rows.groupBy(text.french_date("printed").alias("parsed"), text.french_month("column").alias("month")).agg(F.count("*").alias("n"))


@query("c09_label_folding", "doc_id:int folded", r"""
    select doc_id, md5(trim(regexp_replace(replace(replace(translate(lower(text),
      'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '€', 'eur'), '$', 'usd'), '\s+', ' ', 'g'))) folded from documents""")
def c09(v):
    return v.table("documents").select("doc_id", F.md5(text.fold("text").cast("binary")).alias("folded"))


@query("c09_longest_prefix", "slot n:int", """
    select case when p_name like 'red w%' then 'red_widgets' when p_name like 'red%' then 'red' when p_name like 'blue%' then 'blue' end slot,
      count(*) n from part group by 1""")
def c09_prefix(v):
    slot = text.longest_prefix(text.fold("p_name"), {"red": "red", "red w": "red_widgets", "blue": "blue"})
    return v.table("part").groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))


@query("c10_number_parse", "kind n:int missing:int rejected:int total:num2", """
    select o_orderkey % 6 kind, count(*) n,
      count(*) filter (where o_orderkey % 6 = 3) missing, count(*) filter (where o_orderkey % 6 = 4) rejected,
      sum(case when o_orderkey % 6 in (0, 1, 2, 5) then o_totalprice end) total from orders group by 1""")
def c10(v):
    k, p = F.col("o_orderkey") % 6, F.col("o_totalprice")
    cell = (
        F.when(k == 0, F.format_number(p, 2))
        .when(k == 1, F.concat(F.lit("+"), p.cast("decimal(12,2)").cast("string")))
        .when(k == 2, F.replace(F.format_number(p, 2), F.lit(","), F.lit(" ")))
        .when(k == 3, "n/a")
        .when(k == 4, F.concat(p.cast("string"), F.lit(" (b)")))
        .otherwise(F.concat(F.lit("  "), p.cast("decimal(12,2)").cast("string")))
    )
    rows = v.table("orders").select(k.alias("kind"), cell.alias("cell"))
    value = text.parse_number("cell")
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(text.is_missing_token("cell")).alias("missing"),
        F.count_if(text.number_rejected("cell")).alias("rejected"), F.sum(value).alias("total"),
    )


@query("c11_period_labels", "m:date n:int", "select case when o_orderkey % 7 = 0 then null else date_trunc('month', o_orderdate) end m, count(*) n from orders group by 1")
def c11(v):
    label = F.date_format("o_orderdate", "yyyy'M'MM")
    label = F.when(F.col("o_orderkey") % 7 == 0, F.concat(label, F.lit("p"))).otherwise(label)
    return v.table("orders").groupBy(cal.month_of_label(label).alias("m")).agg(F.count("*").alias("n"))


@query("c12_publishing_round", "kind n:int nulls:int signs:int total:num", """
    select o_orderkey % 4 kind, count(*) n, count(*) filter (where o_orderkey % 4 in (0, 1)) nulls,
      0 signs, sum(case when o_orderkey % 4 = 3 then round(o_totalprice / 7, 6) when o_orderkey % 4 = 2 then 0.0 end) total
    from orders group by 1""")
def c12(v):
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(-1e-9))
        .otherwise(F.col("o_totalprice") / 7)
    )
    rows = v.table("orders").select(k.alias("kind"), numeric.publish(raw).alias("p"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("nulls"),
        F.count_if(F.col("p").cast("string") == "-0.0").alias("signs"), F.sum("p").alias("total"),
    )


@query("c13_revision_text", "vintage:date status value:num entry n:int", """
    select cast(vintage as date) vintage, case when provisional then 'provisional' else 'final' end status, value,
      strftime(vintage, '%Y-%m-%d') || '|' || case when provisional then 'provisional' else 'final' end || '|' || 'v=' || printf('%.2f', value) entry,
      count(*) n from readings group by all""")
def c13(v):
    from spreadlake.operators import vintage as vt

    rows = v.readings.select(vt.format_print(F.to_date("vintage"), F.col("provisional"), {"v": F.format_string("%.2f", F.col("value"))}).alias("entry"))
    return rows.select("entry", vt.parse_print("entry").alias("p")).groupBy(
        F.col("p.vintage").alias("vintage"), F.col("p.status").alias("status"), F.col("p.values")["v"].alias("value"), "entry"
    ).agg(F.count("*").alias("n"))


@query("c14_log_level_and_trend", "region m:date log_intake:num trend:int", """
    select region, m, 100 * ln(intake) log_intake, datediff('month', min(m) over (partition by region), m) trend from panel""")
def c14(v):
    return v.panel.withColumn("log_intake", panel.log_level("intake")).withColumn("trend", panel.trend_months(["region"], "m"))


@query("c15_month_effects", "region month_02:num month_07:num month_12:num n:int", """
    select region, sum(case when month(m) = 2 then 1 else 0 end) month_02, sum(case when month(m) = 7 then 1 else 0 end) month_07,
      sum(case when month(m) = 12 then 1 else 0 end) month_12, count(*) n from panel group by 1""")
def c15(v):
    fe = panel.month_dummies("m")
    rows = v.panel.select("region", *[c.alias(n) for n, c in fe.items()])
    return rows.groupBy("region").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in fe])


EPISODE_LIST = [("episode_1997", "1997-03-01"), ("episode_1999", "1999-02-01"), ("episode_2001", "2001-02-01")]


@query("c16_episode_flags", "region m:date episode_1997:num episode_1999:num episode_2001:num any_episode:num", """
    select region, m, case when m >= date '1997-03-01' and m < date '1998-03-01' then 1 else 0 end episode_1997,
      case when m >= date '1999-02-01' and m < date '2000-02-01' then 1 else 0 end episode_1999,
      case when m >= date '2001-02-01' and m < date '2002-02-01' then 1 else 0 end episode_2001,
      case when exists (select 1 from episodes e where panel.m >= e.start and panel.m < e.start + interval 12 month) then 1 else 0 end any_episode
    from panel""")
def c16(v):
    return panel.episode_flags(v.panel, EPISODE_LIST)


@query("c17_closure_step_dummies", "region dummy mean:num usable:bool", """
    with d as (select region, case when m >= date '1998-01-01' then 1.0 else 0 end s1998,
      case when m >= date '1990-01-01' then 1.0 else 0 end s1990, case when m >= date '2005-01-01' then 1.0 else 0 end s2005 from panel),
    a as (select region, avg(s1998) a, avg(s1990) b, avg(s2005) c from d group by 1)
    select region, 'closure_step_1998' dummy, a mean, a > 0 and a < 1 usable from a
    union all select region, 'closure_step_1990', b, b > 0 and b < 1 from a union all select region, 'closure_step_2005', c, c > 0 and c < 1 from a""")
def c17(v):
    years = (1998, 1990, 2005)
    rows = v.panel.select("region", *[panel.step_dummy("m", y).alias(f"closure_step_{y}") for y in years])
    return panel.usable_dummies(rows, ["region"], [f"closure_step_{y}" for y in years])


@query("c18_interval_position", "product m:date position", """
    select a.product, a.m, case when count(b.v) = 0 or a.v is null then 'none' when a.v > max(b.v) then 'above' when a.v < min(b.v) then 'below' else 'inside' end as position
    from ruled a left join ruled b on b.product = a.product and month(b.m) = month(a.m) and year(b.m) < year(a.m) group by a.product, a.m, a.v""")
def c18(v):
    from pyspark.sql import Window

    # years of one product and calendar month: a short, bounded history
    w = Window.partitionBy("product", F.month("m")).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    rows = v.ruled.withColumn("lo", F.min("v").over(w)).withColumn("hi", F.max("v").over(w)).withColumn("n", F.count("v").over(w))
    return rows.withColumn("position", numeric.interval_position("v", "lo", "hi", "n"))


@query("c19_zero_in_interval", "product m:date zero share:num", """
    select product, m, case when spread is null then null when spread - 200 <= 0 and spread + 200 >= 0 then 'includes_zero' when spread - 200 > 0 then 'above_zero' else 'below_zero' end as zero,
      case when spread - 200 > 0 then 100 * (spread - 200) / 400 when spread + 200 < 0 then 100 * -(spread + 200) / 400 end as share from spreads""")
def c19(v):
    rows = v.spreads.withColumn("lo", F.col("spread") - 200).withColumn("hi", F.col("spread") + 200)
    return rows.withColumn("zero", numeric.zero_class("lo", "hi")).withColumn("share", numeric.zero_share("lo", "hi"))


@query("c20_two_digit_years", "full_year:int vintage n:int", """
    select case when k % 3 = 0 then year(d) when k % 3 = 1 then year(d) - 1 else year(d) // 100 * 100 + (year(d) + 5) % 100 end full_year,
      strftime(d, '%B %Y') vintage, count(*) n from (select o_orderkey k, o_orderdate d from orders) group by 1, 2""")
def c20(v):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    printed = F.when(k == 0, F.year(d)).when(k == 1, F.year(d) - 1).otherwise(F.year(d) + 5) % 100
    title = F.concat(F.lit("Price data, released on "), F.date_format(d, "MMMM yyyy"), F.lit(" edition"))
    rows = v.table("orders").select(
        text.expand_year(printed, d).alias("full_year"), F.regexp_extract(title, r"released on (\w+ \d{4})", 1).alias("vintage")
    )
    return rows.groupBy("full_year", "vintage").agg(F.count("*").alias("n"))


@query("c21_series_names", "name n:int", "select lower(area || '_' || flow || '_' || code || '_kbd') as name, count(*) n from long_stats group by 1")
def c21(v):
    return v.long_stats.groupBy(text.series_name("area", "flow", "code", F.lit("KBD")).alias("name")).agg(F.count("*").alias("n"))
