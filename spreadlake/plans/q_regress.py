"""Panel econometrics: responses, thresholds, races, instruments, breaks.

An equation with month effects and one regressor equals the equation of
month-demeaned values, which lets plain SQL check the general fit and its
autocorrelation-robust error.
"""

from pyspark.sql import functions as F

from spreadlake.functions import numeric
from spreadlake.operators import panel, ranking, regress, threshold
from spreadlake.plans.q_scalar import EPISODE_LIST
from spreadlake.plans.registry import query
from spreadlake.plans.sqlsweep import last_slope, sweep
from spreadlake.session import cut_lineage

FE_NAMES = panel.MONTH_EFFECTS
KEYS = ["region"]

SAMPLE = "(select * from lagged where util is not null and margin_lag is not null)"


def sample(v):
    rows = v.stored_panel.dropna(subset=["util", "margin_lag"])
    return rows.select("*", *[c.alias(n) for n, c in panel.month_dummies("m").items()])


def hac_sql(rows: str, keys: str) -> str:
    """Long-run variance per key of rows (keys, o, v, n, k): a CTE body giving keys and se."""
    return f"""(with r0 as (select *, row_number() over (partition by {keys} order by o) t, greatest(3, floor(4 * power(n / 100.0, 2.0 / 9))) nl from {rows}),
      p as (select {", ".join("a." + k.strip() for k in keys.split(","))}, max(a.n) n, max(a.k) k,
        sum(case when a.t = b.t then 1.0 else 2.0 * (1 - (a.t - b.t) / (a.nl + 1.0)) end * a.v * b.v) s
        from r0 a join r0 b on {" and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))} and a.t - b.t between 0 and a.nl group by all)
      select {keys}, sqrt(greatest(s, 0) * n / (n - k)) se from p)"""


# bivariate and month-demeaned rows: y, x, fitted pieces
PLAIN = f"""(select region, m, util y, margin_lag x, count(*) over w n, avg(margin_lag) over w xb, avg(util) over w yb,
   regr_slope(util, margin_lag) over w b, regr_sxx(util, margin_lag) over w sxx from {SAMPLE} window w as (partition by region))"""
DEMEANED = f"""(select *, sum(x * y) over w / sum(x * x) over w b, sum(x * x) over w sxx, count(*) over w n from (
   select region, m, util - avg(util) over f y, margin_lag - avg(margin_lag) over f x from {SAMPLE} window f as (partition by region, month(m)))
   window w as (partition by region))"""


@query("k01_utilisation_panel", "region m:date util:num source_year:int imports:num4", "select region, m, util, source_year, imports from panel")
def k01(v):
    return v.panel


@query("k02_race_panel", "region m:date log_intake:num margin:num small:num official:num", """
    select p.region, p.m, 100 * ln(p.intake) log_intake, p.margin, s.spread small, p.bench / 8 - month(p.m) official
    from panel p left join spreads s on s.m = p.m and s.product = 'SMALL'""")
def k02(v):
    return race_panel(v).withColumn("log_intake", panel.log_level("intake"))


def race_panel(v):
    small = v.spreads.filter("product = 'SMALL'").select("m", F.col("spread").alias("small"))
    return v.panel.join(small, "m", "left").withColumn("official", F.col("bench") / 8 - F.month("m"))


def design_frame(v):
    rows = v.stored_panel.dropna(subset=["util", "lag1", "lag2", "lag3"])
    rows = panel.episode_flags(rows, EPISODE_LIST)
    rows = rows.withColumn("trend", panel.trend_months(KEYS, "m")).withColumn("step_1998", panel.step_dummy("m", 1998))
    return rows.select("*", *[c.alias(n) for n, c in panel.month_dummies("m").items()])


CONTROLS = ["trend", *FE_NAMES, "step_1998", *[n for n, _ in EPISODE_LIST]]

LAGS = ["lag1", "lag2", "lag3"]
DESIGN = f"""(select region, m, util, 100 * ln(intake) log_intake, margin_lag, bench_lag, lag1, lag2, lag3, datediff('month', min(m) over (partition by region), m) trend,
    {", ".join(f"cast(month(m) = {int(c[-2:])} as int) {c}" for c in FE_NAMES)}, cast(m >= date '1998-01-01' as int) step_1998,
    {", ".join(f"cast(m >= date '{d}' and m < date '{d}' + interval 12 month as int) {n}" for n, d in EPISODE_LIST)}
    from lagged where util is not null and lag1 is not null and lag2 is not null and lag3 is not null)"""


def response_sql(y: str, controls: list[str]) -> str:
    """(region, term, n, k, coef, se, r2) of ``y`` on the lags and their sum: the term asked for is swept last."""
    orders = {"lag1": ("lag2", "lag3", "lag1"), "lag2": ("lag1", "lag3", "lag2"), "lag3": ("lag1", "lag2", "lag3"), "sum_b": ("lag1 - lag3", "lag2 - lag3", "lag3")}
    terms = " union all ".join(f"select region, '{name}' term, m, y0, k, {y} y, {a} p, {b} q, {t} t from z" for name, (a, b, t) in orders.items())
    return f"""(with d as (select *, {y} y0 from {DESIGN}), z as ({sweep("d", "region", [y, *controls, *LAGS], ["m", "y0"], controls)}),
      a as ({terms}), f as (select * replace (k + 1 as k) from ({sweep("a", "region, term", ["y", "p", "q", "t"], ["m", "y0"], ["p", "q"], k="k")})),
      v as ({last_slope("f", "region, term", ["y0"])}), h as (select * from {hac_sql("v", "region, term")}),
      c as (select region, term, max(n) n, max(k) k, max(coef) coef, 1 - sum(e * e) / (var_pop(y0) * count(*)) r2 from v group by 1, 2)
      select c.*, h.se from c join h on h.region = c.region and h.term = c.term)"""


@query("k03_design_matrix", "region m:date trend:num month_02:num month_11:num step_1998:num episode_1999:num lag1:num lag3:num", """
    select region, m, datediff('month', min(m) over (partition by region), m) trend, case when month(m) = 2 then 1 else 0 end month_02,
      case when month(m) = 11 then 1 else 0 end month_11, case when m >= date '1998-01-01' then 1 else 0 end step_1998,
      case when m >= date '1999-02-01' and m < date '2000-02-01' then 1 else 0 end episode_1999, lag1, lag3
    from lagged where util is not null and lag1 is not null and lag2 is not null and lag3 is not null""")
def k03(v):
    return design_frame(v)


@query("k04_ols_bivariate", "region n:int k:int intercept:num slope:num r2:num adj_r2:num ssr:num4", f"""
    select region, count(*) n, 2 k, regr_intercept(util, margin_lag) intercept, regr_slope(util, margin_lag) slope, regr_r2(util, margin_lag) r2,
      1 - (1 - regr_r2(util, margin_lag)) * (count(*) - 1) / (count(*) - 2) adj_r2, regr_syy(util, margin_lag) * (1 - regr_r2(util, margin_lag)) ssr from {SAMPLE} group by 1""")
def k04(v):
    rows = sample(v)
    fit = regress.ols(rows, KEYS, "util", ["margin_lag"])
    scored = regress.score(rows, fit, KEYS, "util", ["margin_lag"])
    out = fit.join(regress.quality_of_fit(scored, KEYS, "util"), KEYS)
    return out.withColumn("intercept", F.col("beta")[0]).withColumn("slope", F.col("beta")[1])


@query("k04_ols_month_effects", "region n:int k:int slope:num", f"""
    with d as (select * from {DEMEANED}), mm as (select region, count(distinct month(m)) c from {SAMPLE} group by 1)
    select d.region, max(n) n, max(c) + 1 k, max(b) slope from d join mm on mm.region = d.region group by 1""")
def k04fe(v):
    xs = [*FE_NAMES, "margin_lag"]
    return regress.ols(sample(v), KEYS, "util", xs).withColumn("slope", F.col("beta")[len(xs)])


@query("k05_newey_west_lag_rule", "area n:int lag:int", """
    select area, count(*) n, greatest(3, floor(4 * power(count(*) / 100.0, 2.0 / 9))) as lag from long_stats group by 1""")
def k05(v):
    from spreadlake.functions.numeric import newey_west_lag

    return v.long_stats.groupBy("area").agg(F.count("*").alias("n")).withColumn("lag", newey_west_lag("n"))


@query("k06_hac_bivariate", "region term coef:num se:num t:num low:num high:num", f"""
    with p as (select *, y - (yb - b * xb) - b * x e from {PLAIN}),
    v as (select region, 'margin_lag' term, m o, e * (x - xb) / sxx v, n, 2 k, b coef from p union all select region, 'const', m, e * (1.0 / n - xb * (x - xb) / sxx), n, 2, yb - b * xb from p),
    h as (select * from {hac_sql("v", "region, term")})
    select distinct h.region, h.term, coef, se, coef / se t, coef - 1.959963984540054 * se low, coef + 1.959963984540054 * se high from h join v on v.region = h.region and v.term = h.term""")
def k06(v):
    rows = sample(v)
    xs = ["margin_lag"]
    scored = regress.score(rows, regress.ols(rows, KEYS, "util", xs), KEYS, "util", xs)
    return regress.hac(scored, KEYS, "m", xs, regress.single_terms(["const", *xs]))


@query("k06_hac_mean", "product coef:num se:num", f"""
    with v as (select product, m o, (v - avg(v) over w) / count(*) over w v, count(*) over w n, 1 k, avg(v) over w coef from ruled where v is not null window w as (partition by product)),
    h as (select * from {hac_sql("v", "product")}) select distinct h.product, coef, se from h join v on v.product = h.product""")
def k06m(v):
    rows = v.ruled.filter("v is not null")
    scored = regress.score(rows, regress.ols(rows, ["product"], "v", []), ["product"], "v", [])
    return regress.hac(scored, ["product"], "m", [], {"mean": {"const": 1.0}})


@query("k07_linear_combination", "region coef:num se:num", f"""
    with p as (select *, y - (yb - b * xb) - b * x e from {PLAIN}),
    v as (select region, m o, e * (1.0 / n - xb * (x - xb) / sxx) + 10 * e * (x - xb) / sxx v, n, 2 k, yb - b * xb + 10 * b coef from p),
    h as (select * from {hac_sql("v", "region")}) select distinct h.region, coef, se from h join v on v.region = h.region""")
def k07(v):
    rows = sample(v)
    xs = ["margin_lag"]
    scored = regress.score(rows, regress.ols(rows, KEYS, "util", xs), KEYS, "util", xs)
    return regress.hac(scored, KEYS, "m", xs, {"at_ten": {"const": 1.0, "margin_lag": 10.0}})


FE_HAC = f"""with d as (select *, y - b * x e from {DEMEANED}), mm as (select region, count(distinct month(m)) c from {SAMPLE} group by 1),
    v as (select d.region, m o, e * x / sxx v, n, c + 1 k, b coef from d join mm on mm.region = d.region), h as (select * from {hac_sql("v", "region")})"""


def mean_lag_response(v, rows=None, keys=KEYS):
    rows = sample(v) if rows is None else rows
    return regress.response(rows, keys, "m", "util", FE_NAMES, ["margin_lag"]).filter("term = 'sum_b'")


@query("k08_response_mean_lag", "region coef:num se:num t:num low:num high:num", f"""
    {FE_HAC} select distinct h.region, coef, se, coef / se t, coef - 1.959963984540054 * se low, coef + 1.959963984540054 * se high from h join v on v.region = h.region""")
def k08(v):
    return mean_lag_response(v)


CAPACITY_MODEL = response_sql("util", [*FE_NAMES, *[n for n, _ in EPISODE_LIST]])


@query("k08_capacity_model", "region term n:int k:int coef:num se:num r2:num", f"select * from {CAPACITY_MODEL}")
def k08c(v):
    """Utilisation on three margin lags, month effects and episode steps."""
    controls = [*FE_NAMES, *[n for n, _ in EPISODE_LIST]]
    return regress.response(design_frame(v), KEYS, "m", "util", controls, ["lag1", "lag2", "lag3"])


@query("k08_trend_model", "region term n:int k:int coef:num se:num r2:num", f"select * from {response_sql('log_intake', CONTROLS)}")
def k08t(v):
    """Log intake on three margin lags with a trend, a closure step, month effects and episode steps."""
    rows = design_frame(v).withColumn("log_intake", panel.log_level("intake"))
    return regress.response(rows, KEYS, "m", "log_intake", CONTROLS, ["lag1", "lag2", "lag3"])


@query("k09_translated_response", "region volume:num4 volume_low:num4 volume_high:num4 share:num share_low:num share_high:num", f"""
    {FE_HAC}, f as (select distinct h.region, coef, se from h join v on v.region = h.region),
    b as (select region, max_by(capacity, m) base, avg(intake) runs from panel group by 1)
    select f.region, coef / 10 * base volume, (coef - 1.959963984540054 * se) / 10 * base volume_low, (coef + 1.959963984540054 * se) / 10 * base volume_high,
      coef / 10 * base / runs as share, (coef - 1.959963984540054 * se) / 10 * base / runs share_low, (coef + 1.959963984540054 * se) / 10 * base / runs share_high
    from f join b on b.region = f.region""")
def k09(v):
    base = v.panel.groupBy("region").agg(F.max_by("capacity", "m").alias("base"), F.avg("intake").alias("runs"))
    rows = mean_lag_response(v).join(base, "region")
    return rows.withColumns(regress.translate("coef", "se", "base", "runs", move=10.0))


VARIANTS = """(select *, 'all' variant from lagged union all select *, 'from_1997' from lagged where year(m) >= 1997
   union all select *, 'without_winter' from lagged where month(m) between 3 and 11)"""


@query("k10_variant_table", "variant region n:int coef:num se:num", f"""
    with s as (select * from {VARIANTS} where util is not null and margin_lag is not null),
    f as (select variant, region, m, util - avg(util) over f y, margin_lag - avg(margin_lag) over f x from s window f as (partition by variant, region, month(m))),
    d as (select *, sum(x * y) over w / sum(x * x) over w b, sum(x * x) over w sxx, count(*) over w n from f window w as (partition by variant, region)),
    mm as (select variant, region, count(distinct month(m)) c from s group by 1, 2),
    v as (select d.variant, d.region, m o, (y - b * x) * x / sxx v, n, c + 1 k, b coef from d join mm on mm.variant = d.variant and mm.region = d.region),
    h as (select * from {hac_sql("v", "variant, region")})
    select distinct h.variant, h.region, n, coef, se from h join v on v.variant = h.variant and v.region = h.region""")
def k10(v):
    rows = regress.variants(sample(v), {
        "all": F.lit(True), "from_1997": F.year("m") >= 1997, "without_winter": F.month("m").between(3, 11),
    })
    return mean_lag_response(v, rows, ["variant", "region"])


# --- threshold ---------------------------------------------------------------

STEP = 0.25

# The margin here is in money per order, about a hundred times a margin per barrel; so is the widest interval.
MAX_WIDTH = 1000.0


def best_sql(rows: str, part: str) -> str:
    """(part, tau) of the best of all candidates of rows (part, x, y, lo, cells), from the running moments of the rows below each."""
    return f"""(with ru as (select {part}, x, lo, cells, lead(x) over (partition by {part} order by x) nx, count(*) over upto nb, avg(x) over upto mx,
        count(*) over upto * var_pop(x) over upto sxx, count(*) over upto * covar_pop(y, x) over upto sxy, count(*) over upto * (avg(y) over upto - avg(y) over whole) ty,
        dense_rank() over (partition by {part} order by x) vals, count(*) over whole n, count(*) over whole * var_pop(y) over whole syy
      from {rows} window upto as (partition by {part} order by x range between unbounded preceding and current row), whole as (partition by {part})),
    ga as (select *, greatest(floor((x - lo) / {STEP}) + 1, 0) a, least(coalesce(floor((nx - lo) / {STEP}), cells - 1), cells - 1) b from ru where nx is null or nx > x
      union all select {part}, x, lo, cells, nx, 0, 0, 0, 0, 0, 1, n, syy, 0, least(floor((x - lo) / {STEP}), cells - 1) from ru where vals = 1 and (nx is null or nx > x)),
    ea as (select *, unnest(range(cast(a as int), cast(b as int) + 1)) i from ga where a <= b),
    sh as (select *, lo + i * {STEP} - mx t, nb * (1 - nb / n) w from ea),
    gn as (select {part}, i, lo, case when nb = 0 or sxx + w * t * t <= 1e-9 then syy when nb = n then syy - sxy * sxy / sxx when vals = 1 then syy - ty * ty / w else syy - (ty * t - sxy) * (ty * t - sxy) / (sxx + w * t * t) end s from sh)
    select {part}, max(lo) + min(struct_pack(s := s, i := i)).i * {STEP} tau from gn group by {part})"""


GRID = f"""(select region, quantile_cont(margin_lag, 0.05) lo, cast(floor((quantile_cont(margin_lag, 0.95) - quantile_cont(margin_lag, 0.05)) / {STEP}) as int) + 1 cells from {SAMPLE} group by 1)"""
TAUS = f"""(select region, lo, cells, i, lo + i * {STEP} tau from (select region, lo, cells, unnest(range(0, cells)) i from {GRID}))"""
PROFILE = f"""(select region, i, tau, case when regr_sxx(y, h) > 1e-9 then regr_syy(y, h) * (1 - coalesce(regr_r2(y, h), 0)) else regr_syy(y, h) end ssr, count(*) n from (
   select s.region, t.i, t.tau, s.util y, greatest(t.tau - s.margin_lag, 0) h from {SAMPLE} s join {TAUS} t on t.region = s.region) group by 1, 2, 3)"""
POINT = f"(select region, min_by(tau, i) tau, min(i) i from (select *, min(round(ssr, 7)) over (partition by region) best from {PROFILE}) where round(ssr, 7) = best group by 1)"


@query("k11_hinge_at_fixed_threshold", "region level:num slope_below:num ssr:num4 r2:num months_below:int", f"""
    with p as (select region, quantile_cont(margin_lag, 0.5) tau from {SAMPLE} group by 1),
    h as (select s.region, util y, greatest(tau - margin_lag, 0) h, margin_lag < tau b from {SAMPLE} s join p on p.region = s.region)
    select region, regr_intercept(y, h) level, -regr_slope(y, h) slope_below, regr_syy(y, h) * (1 - regr_r2(y, h)) ssr, regr_r2(y, h) r2, count(*) filter (where b) months_below from h group by 1""")
def k11(v):
    rows = sample(v)
    point = rows.groupBy("region").agg(F.percentile("margin_lag", 0.5).alias("tau"))
    return threshold.kink_fit(rows, KEYS, "m", "margin_lag", "util", point)


@query("k12_threshold_profile", "region i:int tau:num ssr:num4", f"select region, i, tau, ssr from {PROFILE}")
def k12(v):
    return threshold.profile(sample(v), KEYS, "margin_lag", "util", step=STEP)


@query("k12_threshold_search", "region tau:num ssr:num4 n:int", f"""
    with p as (select * from {PROFILE}) select q.region, q.tau, p.ssr, p.n from {POINT} q join p on p.region = q.region and p.i = q.i""")
def k12s(v):
    return threshold.search(sample(v), KEYS, "margin_lag", "util", step=STEP)


REPS = 2000
BLOCK = f"""(with c as (select region, m, util - avg(util) over (partition by region) x, row_number() over (partition by region order by m) rn from {SAMPLE}),
    d as (select region, sum(x * x) ss, count(*) n from c group by 1),
    a as (select a.region, a.rn - b.rn as lag, sum(a.x * b.x) s from c a join c b on b.region = a.region and a.rn - b.rn between 1 and 36 group by 1, 2)
    select d.region, cast(coalesce(min(case when abs(s / ss) < 2 / sqrt(n) then lag end), max(greatest(1, least(floor(n / 4), 36)))) as int) as block, max(n) n from a join d on d.region = a.region where lag <= greatest(1, least(floor(n / 4), 36)) group by 1)"""
DRAWS = f"""(with pos as (select region, row_number() over (partition by region order by m) - 1 p, util y, margin_lag x from {SAMPLE}),
    bl as (select region, block as b, n from {BLOCK}),
    dr as (select region, b, n, rep, unnest(range(0, cast(ceil(n * 1.0 / b) as int))) j from (select region, b, n, unnest(range(0, {REPS})) rep from bl)),
    st as (select region, rep, j, b, n, ((((rep * 1103515245 + (j + 1) * 12345 + {62 * 69069}) % 2147483648 + (j + 1) * 40503) * 1103515245 + 12345) % 2147483648) // 256 % (n - b + 1) s from dr),
    tk as (select region, rep, unnest(range(s, s + least(b, n - j * b))) p from st),
    sm as (select tk.region, rep, x, y from tk join pos on pos.region = tk.region and pos.p = tk.p),
    sg as (select sm.region, rep, x, y, lo, cells from sm join {GRID} g on g.region = sm.region)
    select region, rep, tau from {best_sql("sg", "region, rep")})"""


@query("k13_block_bootstrap_draws", "region rep:int tau:num", f"select region, rep, tau from {DRAWS}")
def k13(v):
    rows = sample(v)
    bounds = threshold.grid(rows, KEYS, "margin_lag", step=STEP)
    blocks = threshold.block_length(rows, KEYS, "m", "util")
    return threshold.bootstrap_draws(rows, KEYS, "m", "margin_lag", "util", blocks, bounds, REPS, step=STEP)


@query("k14_identification_verdict", "region tau:num ci_low:num ci_high:num identified:bool reasons months_below:int run_first:date run_last:date run_length:int mean_below:num mean_above:num block:int", f"""
    with pt as (select * from {POINT}), g as (select region, lo, lo + (cells - 1) * {STEP} hi from {GRID}), ci as (select region, quantile_cont(tau, 0.025) lo, quantile_cont(tau, 0.975) hi from {DRAWS} group by 1),
    s as (select s.*, pt.tau from {SAMPLE} s join pt on pt.region = s.region),
    sd as (select region, count(*) filter (where margin_lag < tau) months_below, avg(util) filter (where margin_lag < tau) mean_below, avg(util) filter (where margin_lag >= tau) mean_above from s group by 1),
    il as (select region, m, year(m) * 12 + month(m) - row_number() over (partition by region order by m) g from s where margin_lag < tau),
    rn as (select region, min(m) run_first, max(m) run_last, count(*) run_length from il group by region, g qualify row_number() over (partition by region order by count(*) desc, min(m)) = 1)
    select pt.region, pt.tau, ci.lo ci_low, ci.hi ci_high, not (ci.hi - ci.lo > {MAX_WIDTH} or ci.lo <= g.lo + {STEP} or ci.hi >= g.hi - {STEP}) identified,
      concat_ws(';', case when ci.hi - ci.lo > {MAX_WIDTH} then 'interval_too_wide' end, case when ci.lo <= g.lo + {STEP} then 'touches_lower_edge' end, case when ci.hi >= g.hi - {STEP} then 'touches_upper_edge' end) reasons,
      months_below, run_first, run_last, run_length, mean_below, mean_above, bl.block
    from pt join g on g.region = pt.region join ci on ci.region = pt.region join sd on sd.region = pt.region left join rn on rn.region = pt.region join {BLOCK} bl on bl.region = pt.region""")
def k14(v):
    out = threshold.verdict(sample(v), KEYS, "m", "margin_lag", "util", REPS, max_width=MAX_WIDTH, step=STEP)
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query("k15_drop_refits", "variant region tau:num slope_below:num sign_flip:bool", f"""
    with s0 as (select * from {SAMPLE}), pt0 as (select * from {POINT}), j as (select s0.*, pt0.tau t0 from s0 join pt0 on pt0.region = s0.region),
    il as (select region, m, year(m) * 12 + month(m) - row_number() over (partition by region order by m) g from j where margin_lag < t0),
    rn as (select region, min(m) a, max(m) b from il group by region, g qualify row_number() over (partition by region order by count(*) desc, min(m)) = 1),
    s as (select 'all' variant, region, m, util y, margin_lag x from s0
      union all select 'no_episodes', region, m, util, margin_lag from s0 where not exists (select 1 from episodes e where s0.m >= e.start and s0.m < e.start + interval 12 month)
      union all select 'no_longest_run', s0.region, s0.m, util, margin_lag from s0 left join rn on rn.region = s0.region where not coalesce(s0.m between rn.a and rn.b, false)),
    g as (select variant, region, quantile_cont(x, 0.05) lo, cast(floor((quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / {STEP}) as int) + 1 cells from s group by 1, 2),
    t as (select variant, region, i, lo + i * {STEP} tau from (select variant, region, lo, unnest(range(0, cells)) i from g)),
    h as (select s.variant, s.region, t.i, t.tau, y, greatest(t.tau - x, 0) h from s join t on t.variant = s.variant and t.region = s.region),
    p as (select variant, region, i, tau, case when regr_sxx(y, h) > 1e-9 then round(regr_syy(y, h) * (1 - coalesce(regr_r2(y, h), 0)), 7) else round(regr_syy(y, h), 7) end ssr, -regr_slope(y, h) slope from h group by 1, 2, 3, 4),
    b as (select * from p qualify row_number() over (partition by variant, region order by ssr, i) = 1)
    select variant, region, tau, slope slope_below, sign(slope) <> sign(max(case when variant = 'all' then slope end) over (partition by region)) sign_flip from b""")
def k15(v):
    return drop_refits(v)


def drop_refits(v):
    from spreadlake.operators.calendar_ops import longest_run

    rows = panel.episode_flags(sample(v), EPISODE_LIST)
    point = threshold.search(rows, KEYS, "margin_lag", "util", step=STEP).select("region", F.col("tau").alias("tau0"))
    marked = rows.join(point, "region")
    run = longest_run(marked, KEYS, "m", F.col("margin_lag") < F.col("tau0")).select("region", F.col("first").alias("a"), F.col("last").alias("b"))
    marked = marked.join(run, "region", "left")
    in_run = F.coalesce(F.col("m").between(F.col("a"), F.col("b")), F.lit(False))
    sets = regress.variants(marked, {"all": F.lit(True), "no_episodes": F.col("any_episode") == 0, "no_longest_run": ~in_run})
    sets = cut_lineage(sets.select("variant", "region", "m", "util", "margin_lag"), "refits")
    k = ["variant", "region"]
    best = threshold.search(sets, k, "margin_lag", "util", step=STEP)
    fit = threshold.kink_fit(sets, k, "m", "margin_lag", "util", best)
    base = fit.filter("variant = 'all'").select("region", F.col("slope_below").alias("base"))
    return fit.join(base, "region").withColumn("sign_flip", F.signum("slope_below") != F.signum("base"))


SETS = {"5_95": (0.05, 0.95), "2_98": (0.02, 0.98), "0_100": (0.0, 1.0), "10_90": (0.1, 0.9)}
SET_REPS = 600
SET_QUANTILES = ", ".join(str(q) for pair in SETS.values() for q in pair)
SET_ROWS = " union all ".join(f"select region, '{g}' gs, q[{2 * i + 1}] lo, q[{2 * i + 2}] hi from qq" for i, g in enumerate(SETS))


@query("k16_grid_sensitivity", "region grid_set grid_low:num grid_high:num tau:num ci_low:num ci_high:num too_wide:bool touches_edge:bool identified:bool", f"""
    with sm0 as (select region, m, util y, margin_lag x, row_number() over (partition by region order by m) - 1 p from {SAMPLE}),
    qq as (select region, quantile_cont(x, [{SET_QUANTILES}]) q from sm0 group by 1), gg as ({SET_ROWS}),
    t as (select region, gs, i, lo + i * {STEP} tau from (select region, gs, lo, unnest(range(0, cast(floor((hi - lo) / {STEP}) as int) + 1)) i from gg where hi > lo)),
    ge as (select *, cast(floor((hi - lo) / {STEP}) as int) + 1 cells from gg where hi > lo),
    pr as (select s.region, gs, x, y, lo, cells from sm0 s join ge on ge.region = s.region),
    pt as (select * from {best_sql("pr", "region, gs")}),
    en as (select region, gs, min(tau) grid_low, max(tau) grid_high from t group by 1, 2),
    bl as (select region, block as b, n from {BLOCK}),
    dr as (select region, b, n, rep, unnest(range(0, cast(ceil(n * 1.0 / b) as int))) j from (select region, b, n, unnest(range(0, {SET_REPS})) rep from bl)),
    st as (select region, rep, j, b, n, ((((rep * 1103515245 + (j + 1) * 12345 + {62 * 69069}) % 2147483648 + (j + 1) * 40503) * 1103515245 + 12345) % 2147483648) // 256 % (n - b + 1) s from dr),
    tk as (select region, rep, unnest(range(s, s + least(b, n - j * b))) p from st),
    sm as (select tk.region, rep, x, y from tk join sm0 on sm0.region = tk.region and sm0.p = tk.p),
    sg as (select sm.region, gs, rep, x, y, lo, cells from sm join ge on ge.region = sm.region),
    dw as (select * from {best_sql("sg", "region, gs, rep")}),
    ci as (select region, gs, quantile_cont(tau, 0.025) ci_low, quantile_cont(tau, 0.975) ci_high from dw group by 1, 2)
    select pt.region, pt.gs grid_set, grid_low, grid_high, tau, ci_low, ci_high, ci_high - ci_low > {MAX_WIDTH} too_wide,
      ci_low <= grid_low + {STEP} or ci_high >= grid_high - {STEP} touches_edge,
      not (ci_high - ci_low > {MAX_WIDTH} or ci_low <= grid_low + {STEP} or ci_high >= grid_high - {STEP}) identified
    from pt join en on en.region = pt.region and en.gs = pt.gs join ci on ci.region = pt.region and ci.gs = pt.gs""")
def k16(v):
    return threshold.grid_sensitivity(sample(v), KEYS, "m", "margin_lag", "util", SETS, SET_REPS, max_width=MAX_WIDTH, step=STEP)


@query("k17_linear_versus_kink", "region linear_r2:num linear_ssr:num4 r2:num ssr:num4", f"""
    with s as (select s.*, tau from {SAMPLE} s join {POINT} p on p.region = s.region)
    select region, regr_r2(util, margin_lag) linear_r2, regr_syy(util, margin_lag) * (1 - regr_r2(util, margin_lag)) linear_ssr,
      regr_r2(util, greatest(tau - margin_lag, 0)) r2, regr_syy(util, greatest(tau - margin_lag, 0)) * (1 - regr_r2(util, greatest(tau - margin_lag, 0))) ssr from s group by 1""")
def k17(v):
    rows = sample(v)
    best = threshold.search(rows, KEYS, "margin_lag", "util", step=STEP)
    return threshold.kink_fit(rows, KEYS, "m", "margin_lag", "util", best)


# --- race --------------------------------------------------------------------

MIN_TRAIN = 60


@query("k18_expanding_window", "region m:date n_train:int forecast:num benchmark:num error:num", f"""
    with w as (select region, m, util, margin_lag x, count(*) over w n, regr_slope(util, margin_lag) over w b, regr_intercept(util, margin_lag) over w a, avg(util) over w mu
      from {SAMPLE} window w as (partition by region order by m rows between unbounded preceding and 1 preceding))
    select region, m, n n_train, a + b * x forecast, mu benchmark, util - a - b * x error from w where n >= {MIN_TRAIN}""")
def k18(v):
    return regress.expanding_forecasts(sample(v), KEYS, "m", "util", ["margin_lag"], MIN_TRAIN)


FULL = [*FE_NAMES, *[n for n, _ in EPISODE_LIST], *LAGS]


@query("k18_expanding_window_full_equation", "region rmse:num benchmark_rmse:num ratio_to_mean:num n_forecasts:int first_forecast:date last_forecast:date", f"""
    with d as (select * from {DESIGN}), o as (select a.m origin, b.*, b.util y0 from d a join d b on b.region = a.region and b.m <= a.m),
    r as ({sweep("o", "region, origin", ["util", *FULL], ["m", "y0"], FULL, mask="m < origin")}),
    b as (select region, origin, count(*) filter (where m < origin) n, max(case when m = origin then y0 end) - avg(y0) filter (where m < origin) be from o group by 1, 2),
    e as (select r.region, r.origin, r.util e, b.be from r join b on b.region = r.region and b.origin = r.origin where r.m = r.origin and b.n >= {MIN_TRAIN})
    select region, sqrt(avg(e * e)) rmse, sqrt(avg(be * be)) benchmark_rmse, sqrt(avg(e * e)) / sqrt(avg(be * be)) ratio_to_mean, count(*) n_forecasts, min(origin) first_forecast, max(origin) last_forecast
    from e group by 1""")
def k18f(v):
    rows = design_frame(v)
    xs = [*FE_NAMES, *[n for n, _ in EPISODE_LIST], "lag1", "lag2", "lag3"]
    return regress.forecast_scores(regress.expanding_forecasts(rows, KEYS, "m", "util", xs, MIN_TRAIN), KEYS, "m")


def race_rows(v):
    """The common sample of three candidates, each with its strict lag mean."""
    series = race_panel(v).select("m", "margin", "small", "official").distinct()
    wide = panel.with_lags(series, [], "m", "margin", (1, 2, 3), "margin_l")
    wide = panel.with_lags(wide, [], "m", "small", (1, 2, 3), "small_l", dense=False)
    wide = panel.with_lags(wide, [], "m", "official", (1, 2, 3), "official_l", dense=False)
    lags = wide.select("m", *[panel.strict_mean(*[f"{c}_l{n}" for n in (1, 2, 3)]).alias(c) for c in NAMES])
    rows = v.panel.select("region", "m", "util").join(lags, "m").dropna(subset=["util", *NAMES])
    return regress.candidates(rows, {c: [c] for c in NAMES}, ["x"])


NAMES = ["margin", "official", "small"]
RACE = """(with q as (select distinct m, margin, bench / 8 - month(m) official from panel),
   s as (select q.m, q.margin, q.official, sp.spread small from q left join spreads sp on sp.m = q.m and sp.product = 'SMALL'),
   l as (select m, (lag(margin, 1) over w + lag(margin, 2) over w + lag(margin, 3) over w) / 3 margin, (lag(official, 1) over w + lag(official, 2) over w + lag(official, 3) over w) / 3 official,
     (lag(small, 1) over w + lag(small, 2) over w + lag(small, 3) over w) / 3 small from s window w as (order by m)),
   r as (select p.region, p.m, p.util, l.margin, l.official, l.small from panel p join l on l.m = p.m where p.util is not null and l.margin is not null and l.official is not null and l.small is not null)
   select region, m, util, 'margin' candidate, margin x from r union all select region, m, util, 'official', official from r union all select region, m, util, 'small', small from r)"""
RACE_FORECASTS = f"""(select * from (select region, candidate, m, util, count(*) over w n, util - regr_intercept(util, x) over w - regr_slope(util, x) over w * x e, util - avg(util) over w be
   from {RACE} window w as (partition by region, candidate order by m rows between unbounded preceding and 1 preceding)) where n >= {MIN_TRAIN})"""


def race_forecasts(v):
    return cut_lineage(regress.expanding_forecasts(race_rows(v), ["region", "candidate"], "m", "util", ["x"], MIN_TRAIN), "race")


@query("k19_candidate_race", "region candidate rmse:num benchmark_rmse:num n_forecasts:int", f"""
    select region, candidate, sqrt(avg(e * e)) rmse, sqrt(avg(be * be)) benchmark_rmse, count(*) n_forecasts from {RACE_FORECASTS} group by 1, 2""")
def k19(v):
    return regress.forecast_scores(race_forecasts(v), ["region", "candidate"], "m")


PAIRS = f"""(with f as (select * from {RACE_FORECASTS}), d as (select a.region, a.candidate as first, b.candidate as second, a.m o, a.e * a.e - b.e * b.e d, a.e * a.e la, b.e * b.e lb
     from f a join f b on b.region = a.region and b.m = a.m and a.candidate < b.candidate),
   v as (select region, first, second, o, (d - avg(d) over w) / count(*) over w v, count(*) over w n, 1 k from d window w as (partition by region, first, second)),
   h as (select * from {hac_sql("v", "region, first, second")}),
   g as (select region, first, second, avg(d) mean_difference, count(*) n, sqrt(avg(la)) ra, sqrt(avg(lb)) rb from d group by 1, 2, 3)
   select g.*, h.se, mean_difference / h.se t, coalesce(abs(mean_difference / h.se) > 1.959963984540054, false) distinguishable from g join h on h.region = g.region and h.first = g.first and h.second = g.second)"""


@query("k20_loss_differentials", "region first second mean_difference:num se:num t:num n:int distinguishable:bool", f"select * from {PAIRS}")
def k20(v):
    return regress.loss_differentials(race_forecasts(v), KEYS, "m", NAMES)


@query("k21_detectable_gap", "region first second observed_gap_percent:num detectable_gap_percent:num forecasts_needed:num2", f"""
    select region, first, second, 100 * (greatest(ra, rb) - least(ra, rb)) / greatest(ra, rb) observed_gap_percent,
      100 * (sqrt(power(least(ra, rb), 2) + 1.959963984540054 * se) - least(ra, rb)) / sqrt(power(least(ra, rb), 2) + 1.959963984540054 * se) detectable_gap_percent,
      n * power((1.959963984540054 + 1.6448536269514722) * se / mean_difference, 2) forecasts_needed from {PAIRS}""")
def k21(v):
    return regress.with_power(k20(v))


@query("k21_power", "region first second power:num", f"""
    with e as (select region, first, second, coalesce(abs(mean_difference / case when se > 0 then se end), 0) e from {PAIRS})
    select region, first, second, {numeric.normal_cdf_text("e - 1.959963984540054e0")} + {numeric.normal_cdf_text("-e - 1.959963984540054e0")} power from e""")
def k21p(v):
    return regress.with_power(k20(v))


@query("k22_race_verdict", "region best best_rmse:num lead_percent:num any_distinguishable:bool pairs:int verdict", f"""
    with s as (select region, candidate, sqrt(avg(e * e)) rmse from {RACE_FORECASTS} group by 1, 2),
    r as (select *, row_number() over (partition by region order by rmse, candidate) r from s),
    b as (select region, max(case when r = 1 then candidate end) best, max(case when r = 1 then rmse end) best_rmse, max(case when r = 2 then rmse end) s2 from r group by 1),
    p as (select region, bool_or(distinguishable) d, count(*) pairs from {PAIRS} group by 1)
    select b.region, best, best_rmse, 100 * (s2 - best_rmse) / s2 lead_percent, d any_distinguishable, pairs, case when d then 'ordering_informative' else 'cannot_tell_apart' end verdict
    from b join p on p.region = b.region""")
def k22(v):
    forecasts = race_forecasts(v)
    scores = regress.forecast_scores(forecasts, ["region", "candidate"], "m")
    return regress.verdict(scores, regress.loss_differentials(forecasts, KEYS, "m", NAMES), KEYS)


@query("k22_candidate_ranking", "region candidate rank:int gap:num", f"""
    with s as (select region, candidate, sqrt(avg(e * e)) rmse from {RACE_FORECASTS} group by 1, 2)
    select region, candidate, row_number() over w rank, lead(rmse) over w - rmse gap from s window w as (partition by region order by rmse, candidate)""")
def k22r(v):
    scores = regress.forecast_scores(race_forecasts(v), ["region", "candidate"], "m")
    return ranking.gap_to_second(scores, KEYS, "candidate", "rmse")


@query("k23_long_sample_variant", "region n:int coef:num se:num", f"""
    with l as (select m, (lag(spread, 1) over w + lag(spread, 2) over w + lag(spread, 3) over w) / 3 x from spreads where product = 'SMALL' window w as (order by m)),
    s as (select d.region, d.m, 1200 * d.intake / (c.cap / 1e6) y, l.x from runs d join capacity c on c.region = d.region and c.y = year(d.m) - 1 join l on l.m = d.m where l.x is not null),
    p as (select *, count(*) over w n, avg(x) over w xb, regr_slope(y, x) over w b, regr_intercept(y, x) over w a, regr_sxx(y, x) over w sxx from s window w as (partition by region)),
    v as (select region, m o, (y - a - b * x) * (x - xb) / sxx v, n, 2 k, b coef from p), h as (select * from {hac_sql("v", "region")})
    select distinct h.region, n, coef, se from h join v on v.region = h.region""")
def k23(v):
    small = v.spreads.filter("product = 'SMALL'").select("m", "spread")
    lags = panel.with_lags(small, [], "m", "spread", (1, 2, 3)).select("m", panel.strict_mean("lag1", "lag2", "lag3").alias("x"))
    annual = v.capacity.select("region", "y", (F.col("cap") / 1e6).alias("capacity"))
    rows = panel.utilisation(v.runs, annual, KEYS, 1, 1200.0).join(lags, "m")
    return regress.response(rows, KEYS, "m", "util", [], ["x"]).filter("term = 'x'")


# --- instrument and break ----------------------------------------------------

IV = f"""(select *, count(*) over w n, sum(z * x) over w / sum(z * z) over w p, sum(z * y) over w / sum(z * x) over w biv, sum(x * y) over w / sum(x * x) over w bols,
   sum(z * z) over w szz, sum(x * x) over w sxx from (select region, m, util - avg(util) over f y, margin_lag - avg(margin_lag) over f x, bench_lag - avg(bench_lag) over f z
   from {SAMPLE} where bench_lag is not null window f as (partition by region, month(m))) window w as (partition by region))"""
IV_V = f"""with d as (select * from {IV}), mm as (select region, count(distinct month(m)) c from {SAMPLE} group by 1),
    v as (select d.region, 'first' term, m o, (x - p * z) * z / szz v, n, c + 1 k, p coef from d join mm on mm.region = d.region
      union all select d.region, 'iv', m, (y - biv * x) * (p * z) / (p * p * szz), n, c + 1, biv from d join mm on mm.region = d.region
      union all select d.region, 'ols', m, (y - bols * x) * x / sxx, n, c + 1, bols from d join mm on mm.region = d.region),
    h as (select * from {hac_sql("v", "region, term")}), f as (select distinct h.region, h.term, coef, se from h join v on v.region = h.region and v.term = h.term)"""


@query("k24_two_stage_least_squares", "region first_coef:num first_se:num first_f:num4 partial_r2:num iv_coef:num4 iv_se:num4 ols_coef:num ols_se:num weak:bool", f"""
    {IV_V}, pr as (select region, 1 - sum(power(x - p * z, 2)) / sum(x * x) partial_r2 from d group by 1)
    select f.region, max(case when term = 'first' then coef end) first_coef, max(case when term = 'first' then se end) first_se, max(case when term = 'first' then power(coef / se, 2) end) first_f,
      max(partial_r2) partial_r2, max(case when term = 'iv' then coef end) iv_coef, max(case when term = 'iv' then se end) iv_se, max(case when term = 'ols' then coef end) ols_coef,
      max(case when term = 'ols' then se end) ols_se, not max(case when term = 'first' then power(coef / se, 2) end) > 10 weak from f join pr on pr.region = f.region group by 1""")
def k24(v):
    return regress.instrument(sample(v), KEYS, "m", "util", "margin_lag", "bench_lag", FE_NAMES)


LADDER = {
    "1_constant": [],
    "2_months": FE_NAMES,
    "3_episodes": [*FE_NAMES, *[n for n, _ in EPISODE_LIST]],
    "4_trend": [*FE_NAMES, *[n for n, _ in EPISODE_LIST], "trend"],
}


def ladder(v):
    rows = design_frame(v).dropna(subset=["margin_lag", "bench_lag"])
    controls = LADDER["4_trend"]
    return regress.first_stage(regress.masked(rows, LADDER, controls, "rung"), ["region", "rung"], "m", "margin_lag", "bench_lag", controls)


RUNGS = " union all ".join(
    f"select region, '{rung}' rung, m, k, margin_lag y, bench_lag t from ({sweep('d', 'region', ['margin_lag', 'bench_lag', *controls], ['m'], controls)})"
    for rung, controls in LADDER.items()
)


@query("k25_control_ladder", "region rung coef:num se:num f:num4 partial_r2:num", f"""
    with d as (select * from {DESIGN} where margin_lag is not null and bench_lag is not null), a as (select * replace (k + 1 as k) from ({RUNGS})),
    v as ({last_slope("a", "region, rung", [])}), h as (select * from {hac_sql("v", "region, rung")}),
    c as (select region, rung, max(coef) coef, 1 - sum(e * e) / sum(y * y) partial_r2 from v group by 1, 2)
    select c.*, se, power(coef / se, 2) f from c join h on h.region = c.region and h.rung = c.rung""")
def k25(v):
    return ladder(v)


@query("k25_ladder_first_rungs", "region rung coef:num se:num", f"""
    with s as (select region, m, margin_lag x, bench_lag z from {SAMPLE} where bench_lag is not null),
    d as (select region, '1_constant' rung, m, x - avg(x) over a x, z - avg(z) over a z, 2 k from s window a as (partition by region)
      union all select region, '2_months', m, x - avg(x) over b, z - avg(z) over b, (select count(distinct month(m)) from s s2 where s2.region = s.region) + 1 from s window b as (partition by region, month(m))),
    c as (select *, sum(x * z) over w / sum(z * z) over w p, sum(z * z) over w szz, count(*) over w n from d window w as (partition by region, rung)),
    v as (select region, rung, m o, (x - p * z) * z / szz v, n, k, p coef from c), h as (select * from {hac_sql("v", "region, rung")})
    select distinct h.region, h.rung, coef, se from h join v on v.region = h.region and v.rung = h.rung""")
def k25f(v):
    return ladder(v).filter(F.col("rung").isin("1_constant", "2_months"))


@query("k26_instrument_spread", "region sd_inside:num sd_outside:num peak:num peak_at:date periods_inside:int", f"""
    with s as (select *, exists (select 1 from episodes e where l.m >= e.start and l.m < e.start + interval 12 month) ins from {SAMPLE} l where bench_lag is not null)
    select region, stddev_samp(bench_lag) filter (where ins) sd_inside, stddev_samp(bench_lag) filter (where not ins) sd_outside, max(bench_lag) peak,
      (array_agg(m order by bench_lag desc, m))[1] peak_at, count(*) filter (where ins) periods_inside from s group by 1""")
def k26(v):
    rows = panel.episode_flags(sample(v), EPISODE_LIST).dropna(subset=["bench_lag"])
    return regress.instrument_spread(rows, KEYS, "m", "bench_lag", F.col("any_episode") > 0)


@query("k27_break_residuals", "region m:date fitted:num resid:num resid_in_sd:num pre_sd:num n_pre:int n_post:int verdict", f"""
    with s as (select region, m, util y, margin_lag x from {SAMPLE}),
    f as (select region, regr_slope(y, x) b, regr_intercept(y, x) a, count(*) n from s where m < date '2001-01-01' group by 1),
    sd as (select s.region, stddev_samp(y - a - b * x) sd from s join f on f.region = s.region where m < date '2001-01-01' group by 1)
    select s.region, s.m, a + b * x fitted, y - a - b * x resid, (y - a - b * x) / sd resid_in_sd, sd pre_sd, n n_pre, count(*) over (partition by s.region) n_post,
      case when count(*) over (partition by s.region) < 12 then 'too_short' else 'reportable' end verdict
    from s join f on f.region = s.region join sd on sd.region = s.region where m >= date '2001-01-01'""")
def k27(v):
    return regress.break_residuals(sample(v), KEYS, "m", "util", ["margin_lag"], "2001-01-01")


BREAK_TERMS = [*FE_NAMES, *LAGS]


@query("k27_break_full_equation", "region m:date fitted:num resid_in_sd:num n_post:int verdict", f"""
    with d as (select *, util y0 from {DESIGN}), r as ({sweep("d", "region", ["util", *BREAK_TERMS], ["m", "y0"], BREAK_TERMS, mask="m < date '2000-01-01'")}),
    s as (select region, stddev_samp(util) filter (where m < date '2000-01-01') sd, count(*) filter (where m >= date '2000-01-01') n_post from r group by 1)
    select r.region, m, y0 - util fitted, util / sd resid_in_sd, n_post, case when n_post < 12 then 'too_short' else 'reportable' end verdict
    from r join s on s.region = r.region where m >= date '2000-01-01' and util is not null""")
def k27f(v):
    xs = [*FE_NAMES, "lag1", "lag2", "lag3"]
    return regress.break_residuals(design_frame(v), KEYS, "m", "util", xs, "2000-01-01")
