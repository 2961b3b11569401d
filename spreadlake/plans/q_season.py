"""Seasonality."""

from pyspark.sql import functions as F

from spreadlake.functions.numeric import interval_position
from spreadlake.operators import calendar_ops, regress, seasonal
from spreadlake.plans.q_vintage import swapped
from spreadlake.plans.registry import query


def band_sql(source, slots, excluded="(0)", keys="product", filt=""):
    """source: (keys, y, slot, v)."""
    return f"""(with d as (select * from {source} where v is not null), c as (select {keys}, max(y) cy from d group by all),
    yr as (select distinct d.{keys}, y from d join c on c.{keys} = d.{keys} where y < cy and y not in {excluded} qualify dense_rank() over (partition by d.{keys} order by y desc) <= 5),
    p as (select d.{keys}, slot, count(*) n_years, min(v) minimum, quantile_cont(v, 0.25) p25, median(v) median, quantile_cont(v, 0.75) p75, max(v) maximum, avg(v) mean,
       string_agg(d.y || '=' || printf('%.2f', v), ';' order by d.y) by_year from d join yr on yr.{keys} = d.{keys} and yr.y = d.y group by 1, 2),
    k as (select d.{keys}, slot, v as current from d join c on c.{keys} = d.{keys} and d.y = c.cy),
    s as (select {keys}, unnest(range(1, {slots} + 1)) slot from c),
    ys as (select {keys}, string_agg(cast(y as varchar), ';' order by y) years_used from yr group by 1)
    select s.{keys}, s.slot, coalesce(n_years, 0) n_years, minimum, p25, median, p75, maximum, mean, current, years_used, by_year, cy current_year
    from s left join p on p.{keys} = s.{keys} and p.slot = s.slot left join k on k.{keys} = s.{keys} and k.slot = s.slot
    left join ys on ys.{keys} = s.{keys} join c on c.{keys} = s.{keys})"""


MONTHLY = "(select product, year(m) y, month(m) slot, v from ruled)"
WEEKLY = "(select product, isoyear(date) y, week(date) slot, avg(price) v from quotes group by 1, 2, 3)"
BAND_COLUMNS = "product slot:int n_years:int minimum:num p25:num median:num p75:num maximum:num mean:num current:num years_used"


def weekly(v):
    return calendar_ops.period_mean(v.quotes, ["product"], "date", "price", min_obs=0, grain="weekly")


def _years(df):
    return df.withColumn("years_used", F.array_join(F.transform("years_used", lambda x: x.cast("string")), ";"))


@query("l01_monthly_band", BAND_COLUMNS, f"select * from {band_sql(MONTHLY, 12)}")
def l01(v):
    return _years(seasonal.band(v.ruled, ["product"], "m", "v"))


@query("l02_weekly_band", BAND_COLUMNS, f"select * from {band_sql(WEEKLY, 53)}")
def l02(v):
    return _years(seasonal.band(weekly(v), ["product"], "period", "value", grain="weekly"))


@query("l03_excluded_years", "variant " + BAND_COLUMNS, f"""
    select 'all' variant, * from {band_sql(MONTHLY, 12)} union all select 'without_1998' variant, * from {band_sql("(select * from (select product, year(m) y, month(m) slot, v from ruled) where y <> 1998)", 12)}""")
def l03(v):
    rows = regress.variants(v.ruled, {"all": F.lit(True), "without_1998": F.year("m") != 1998})
    return _years(seasonal.band(rows, ["variant", "product"], "m", "v"))


@query("l03_years_excluded_from_the_band", BAND_COLUMNS, f"select * from {band_sql(MONTHLY, 12, excluded='(1997, 1998)')}")
def l03_parameter(v):
    return _years(seasonal.band(v.ruled, ["product"], "m", "v", excluded=(1997, 1998)))


DEM = "(select product, m, year(m) y, month(m) mo, v - avg(v) over w dm, count(*) over w c from ruled where v is not null window w as (partition by product, year(m)))"


@query("l04_seasonal_shape", "product month:int mean:num se:num years:int", f"""
    select product, mo as month, avg(dm) mean, stddev_samp(dm) / sqrt(count(*)) se, count(*) as years from {DEM} where c = 12 group by 1, 2""")
def l04(v):
    return seasonal.shape(v.ruled, ["product"], "m", "v")


def claim_sql(dem, inside, span):
    return f"""(with l as (select product, y - o season, o, mo, dm from {dem}, range(0, {span}) t(o) where c = 12),
    s as (select product, season, avg(case when {inside} then dm end) i, avg(case when not ({inside}) then dm end) x from l group by 1, 2 having count(*) = 12 * {span}),
    a as (select product, count(*) seasons, min(season) first_season, max(season) last_season, avg(i - x) difference, median(i - x) median, case when count(*) > 1 then stddev_samp(i - x) / sqrt(count(*)) end se,
      count(*) filter (where i - x > 0) positive from s group by 1)
    select *, case when se > 0 then difference / se end t, coalesce(difference / se > 1.959963984540054, false) holds from a)"""


CLAIM_COLUMNS = "claim product seasons:int first_season:int last_season:int difference:num median:num se:num t:num positive:int holds:bool"
SUMMER_SQL = "mo between 4 and 8"
WINTER_SQL = "(o = 0 and mo in (11, 12)) or (o = 1 and mo in (1, 2, 3))"


def claims(df):
    summer = seasonal.claim(seasonal.seasons(df, ["product"], "m", "v", seasonal.SUMMER), ["product"]).withColumn("claim", F.lit("summer"))
    winter = seasonal.claim(seasonal.seasons(df, ["product"], "m", "v", seasonal.WINTER), ["product"]).withColumn("claim", F.lit("winter"))
    return summer.unionByName(winter)


@query("l05_season_claims", CLAIM_COLUMNS, f"""
    select 'summer' claim, * from {claim_sql(DEM, SUMMER_SQL, 1)} union all select 'winter' claim, * from {claim_sql(DEM, WINTER_SQL, 2)}""")
def l05(v):
    return claims(v.ruled)


@query("l06_claims_on_alternative_row", CLAIM_COLUMNS, f"""
    with r as (select a.m, a.spread h, b.spread x from spreads a join spreads b on b.m = a.m and b.product = 'SMALL' where a.product = 'LARGE'),
    u as (select 'headline' product, m, h v from r union all select 'substituted', m, case when x > h then x else h end from r),
    d as (select product, m, year(m) y, month(m) mo, v - avg(v) over w dm, count(*) over w c from u where v is not null window w as (partition by product, year(m)))
    select 'summer' claim, * from {claim_sql("d", SUMMER_SQL, 1)} union all select 'winter' claim, * from {claim_sql("d", WINTER_SQL, 2)}""")
def l06(v):
    items = F.array(
        F.struct(F.lit("headline").alias("product"), F.col("h").alias("v")),
        F.struct(F.lit("substituted").alias("product"), F.col("substituted").alias("v")),
    )
    return claims(swapped(v).select("m", F.inline(items)))


@query("l07_latest_week_position", "product at:date value:num position excess:num n_years:int", f"""
    with w as (select product, cast(date_trunc('week', date) as date) wk, avg(price) v from quotes group by 1, 2), l as (select product, max(wk) lw, max_by(v, wk) v from w group by 1)
    select l.product, l.lw as "at", l.v as value, case when n_years = 0 then 'none' when l.v > maximum then 'above' when l.v < minimum then 'below' else 'inside' end as position,
      case when n_years > 0 then l.v - maximum end excess, n_years from l join {band_sql(WEEKLY, 53)} b on b.product = l.product and b.slot = week(l.lw)""")
def l07(v):
    from spreadlake.operators.ranking import latest

    rows = weekly(v)
    last = latest(rows, ["product"], "period", "value").withColumn("slot", F.weekofyear("at"))
    band = seasonal.band(rows, ["product"], "period", "value", grain="weekly").select("product", "slot", "minimum", "maximum", "n_years")
    out = last.join(band, ["product", "slot"])
    return out.withColumn("position", interval_position("value", "minimum", "maximum", "n_years")).withColumn(
        "excess", F.when(F.col("n_years") > 0, F.col("value") - F.col("maximum"))
    )


@query("l08_band_panel", "product slot:int by_year current:num", f"select product, slot, by_year, current from {band_sql(MONTHLY, 12)}")
def l08(v):
    out = seasonal.band(v.ruled, ["product"], "m", "v")
    text = F.transform("by_year", lambda r: F.concat(r["_year"].cast("string"), F.lit("="), F.format_string("%.2f", r["_v"])))
    return out.withColumn("by_year", F.when(F.size("by_year") > 0, F.array_join(text, ";")))


@query("l09_demeaned_year_lines", "product m:date demeaned:num complete:bool", f"select product, m, dm demeaned, c = 12 complete from {DEM}")
def l09(v):
    return seasonal.demean_complete_years(v.ruled, ["product"], "m", "v", partial=True)
