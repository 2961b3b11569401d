"""Regressions by key: cross products as Spark sums, tiny solves, HAC errors as scalar sums.

A panel has one row per entity and calendar period. Entities, variants,
candidates and control sets are all just keys, so any number of equations is
one job: sums by key, one small solve per key, a join back, sums again.

Newey-West without a sandwich matrix: the variance of w'b is the long-run
variance of the scalar series v(t) = e(t) * (w' (X'X)^-1 x(t)), so each wanted
coefficient costs one number per row instead of a k x k matrix per lag.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions.frames import by
from spreadlake.functions.linalg import expanding, solve
from spreadlake.functions.numeric import newey_west_lag, normal_cdf, ratio

Z95 = 1.959963984540054  # Fixed value: two-sided 95 percent point of the normal distribution.
Z_POWER_95 = 1.6448536269514722  # Fixed value: one-sided 95 percent point.


def variants(df: DataFrame, rules: Mapping[str, Column], name: str = "variant") -> DataFrame:
    """Rows repeated under every variant whose rule they meet: one generator, no union of scans."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(v)) for v, rule in rules.items()]))
    return df.withColumn(name, F.explode(hits))


def candidates(df: DataFrame, columns: Mapping[str, Sequence[str]], names: Sequence[str], name: str = "candidate") -> DataFrame:
    """Each row once per candidate, its own regressors under common names."""
    items = []
    for candidate, cols in columns.items():
        fields = [F.lit(candidate).alias(name)] + [F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]
        items.append(F.struct(*fields))
    return df.select("*", F.inline(F.array(*items)))


def _moment_columns(y: str, xs: Sequence[str]) -> list[Column]:
    """Everything a fit needs from its rows, as plain sums (partial aggregation applies)."""
    empty = F.array().cast("array<double>")
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in xs[i:]]
    return [
        F.count(F.lit(1)).cast("double").alias("_n"),
        (F.array(*[F.sum(F.col(x)) for x in xs]) if xs else empty).alias("_sx"),
        (F.array(*pairs) if xs else empty).alias("_sxx"),
        F.sum(F.col(y)).alias("_sy"),
        (F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs]) if xs else empty).alias("_sxy"),
    ]


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """One fit row per key: n, k, beta (constant first), inv, ybar and the lag rule."""
    sums = df.groupBy(*keys).agg(*_moment_columns(y, xs))
    solved = sums.withColumn("_f", solve("_n", "_sx", "_sxx", "_sy", "_sxy"))
    return solved.select(
        *keys,
        F.col("_n").cast("int").alias("n"),
        F.col("_f.k").alias("k"),
        F.col("_f.beta").alias("beta"),
        F.col("_f.inv").alias("inv"),
        (F.col("_sy") / F.col("_n")).alias("ybar"),
        newey_west_lag("_n").alias("nw_lag"),
    )


def linear(beta: str, xs: Sequence[str]) -> Column:
    terms = [F.col(beta)[0]] + [F.col(beta)[i + 1] * F.col(x) for i, x in enumerate(xs)]
    return reduce(lambda a, b: a + b, terms)


def score(df: DataFrame, fit: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Rows with fitted value and residual. The fit has one row per key, so size decides the join."""
    own = [c for c in fit.columns if c in df.columns and c not in keys]
    out = df.drop(*own).join(fit, list(keys)).withColumn("fitted", linear("beta", xs))
    return out.withColumn("resid", F.col(y) - F.col("fitted"))


def quality_of_fit(scored: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """SSR, R2 and adjusted R2 from actual residuals."""
    agg = scored.groupBy(*keys).agg(
        F.sum(F.col("resid") * F.col("resid")).alias("ssr"),
        F.sum(F.pow(F.col(y) - F.col("ybar"), 2)).alias("_tss"),
        F.max("n").alias("_n"),
        F.max("k").alias("_k"),
    )
    r2 = 1 - ratio("ssr", "_tss")
    dof = F.col("_n") - F.col("_k")
    adj = F.when(dof > 0, 1 - (1 - r2) * (F.col("_n") - 1) / dof)
    return agg.withColumn("r2", r2).withColumn("adj_r2", adj).drop("_tss", "_n", "_k")


def _direction(weights: Mapping[int, float], size: int) -> list[Column]:
    """Entries of (X'X)^-1 w, read off the fit row."""
    return [
        reduce(lambda a, b: a + b, [F.col("inv")[j * size + i] * F.lit(float(w)) for j, w in weights.items()])
        for i in range(size)
    ]


def long_run_sum(v: Column, lag: Column) -> Column:
    """Bartlett-weighted autocovariance sum of one ordered array."""
    n = F.size(v)

    def at(step: Column) -> Column:
        length = F.greatest(n - step, F.lit(0))
        product = F.zip_with(F.slice(v, step + 1, length), F.slice(v, F.lit(1), length), lambda a, b: a * b)
        total = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
        weight = F.when(step == 0, F.lit(1.0)).otherwise(2.0 * (1.0 - step / (lag + 1.0)))
        return weight * total

    steps = F.sequence(F.lit(0), F.least(lag, n - 1))
    return F.aggregate(F.transform(steps, at), F.lit(0.0), lambda s, x: s + x)


def hac(
    scored: DataFrame,
    keys: Sequence[str],
    order: str,
    xs: Sequence[str],
    terms: Mapping[str, Mapping[str, float]],
    resid: str = "resid",
) -> DataFrame:
    """Coefficient, Newey-West error, t and 95 percent interval for each wanted combination.

    ``terms`` maps a label to weights over ``const`` and the design columns.
    The ordered array of one key is as long as its calendar.
    """
    names = ["const", *xs]
    size = len(names)
    position = {n: i for i, n in enumerate(names)}
    values, coefs = [], []
    for label, weights in terms.items():
        w = {position[n]: c for n, c in weights.items()}
        z = _direction(w, size)
        proj = reduce(lambda a, b: a + b, [z[0]] + [z[i + 1] * F.col(x) for i, x in enumerate(xs)])
        values.append((F.col(resid) * proj).alias(f"v{len(values)}"))
        coefs.append(reduce(lambda a, b: a + b, [F.col("beta")[j] * F.lit(float(c)) for j, c in w.items()]))
    rows = scored.select(*keys, F.col(order).alias("_o"), "n", "k", "nw_lag", *values, F.array(*coefs).alias("_coef"))
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_o", *[f"v{i}" for i in range(len(terms))]))).alias("_s"),
        F.first("_coef").alias("_coef"), F.max("n").alias("n"), F.max("k").alias("k"), F.max("nw_lag").alias("nw_lag"),
    )
    dof = F.col("n") - F.col("k")
    items = []
    for i, label in enumerate(terms):
        series = F.col("_s").getField(f"v{i}")
        total = F.greatest(long_run_sum(series, F.col("nw_lag")), F.lit(0.0))
        se = F.sqrt(F.when(dof > 0, total * F.col("n") / dof))
        items.append(F.struct(F.lit(label).alias("term"), F.col("_coef")[i].alias("coef"), se.alias("se"), F.col("n").alias("n"), F.col("k").alias("k")))
    long = packed.withColumn("_items", F.array(*items)).select(*keys, F.inline("_items"))
    return (
        long.withColumn("t", F.when(F.col("se") > 0, F.col("coef") / F.col("se")))
        .withColumn("low", F.col("coef") - Z95 * F.col("se"))
        .withColumn("high", F.col("coef") + Z95 * F.col("se"))
    )


def single_terms(names: Sequence[str]) -> dict[str, dict[str, float]]:
    return {n: {n: 1.0} for n in names}


def response(
    df: DataFrame, keys: Sequence[str], order: str, y: str, controls: Sequence[str], lags: Sequence[str]
) -> DataFrame:
    """The response equation: every lag and their sum, with HAC errors and fit quality."""
    xs = [*controls, *lags]
    rows = df.dropna(subset=[y, *lags])
    scored = score(rows, ols(rows, keys, y, xs), keys, y, xs)
    terms = {**single_terms(lags), "sum_b": {x: 1.0 for x in lags}}
    out = hac(scored, keys, order, xs, terms)
    return out.join(quality_of_fit(scored, keys, y), list(keys))


def translate(coef: str, se: str, base: str, runs: str, move: float = 10.0) -> dict[str, Column]:
    """Percentage points per unit into volume and share; a non-positive base has no answer."""
    ok = (F.col(base) > 0) & (F.col(runs) > 0)

    def volume(c: Column) -> Column:
        return F.when(ok, c / 100.0 * move * F.col(base))

    low, high = F.col(coef) - Z95 * F.col(se), F.col(coef) + Z95 * F.col(se)
    out = {"volume": volume(F.col(coef)), "volume_low": volume(low), "volume_high": volume(high)}
    out.update({f"share{n[6:]}": c / F.col(runs) for n, c in list(out.items())})
    return out


def masked(df: DataFrame, sets: Mapping[str, Sequence[str]], columns: Sequence[str], name: str) -> DataFrame:
    """One copy of the rows per control set; columns outside the set are zero and drop out of the fit."""
    out = df.withColumn(name, F.explode(F.array(*[F.lit(s) for s in sets])))
    for c in columns:
        inside = [s for s, cols in sets.items() if c in cols]
        out = out.withColumn(c, F.when(F.col(name).isin(*inside), F.col(c)).otherwise(F.lit(0.0)) if inside else F.lit(0.0))
    return out


# --- expanding window race -------------------------------------------------


def expanding_forecasts(
    df: DataFrame, keys: Sequence[str], order: str, y: str, xs: Sequence[str], min_train: int
) -> DataFrame:
    """One-step forecasts from fits on the rows before each origin, and the mean benchmark.

    The sums of the rows before an origin are running sums, so a key costs one
    pass over its calendar and one small solve per origin; nothing at or after
    the origin enters.
    """
    rows = df.dropna(subset=[y, *xs]).select(*keys, order, F.col(y).cast("double").alias(y), *[F.col(x).cast("double").alias(x) for x in xs])
    kept = [f"`{n}` {t}" for n, t in rows.dtypes if n in (*keys, order, y)]
    schema = ", ".join([*kept, "n_train int, forecast double, benchmark double, error double, benchmark_error double"])
    names = [n for n, _ in rows.dtypes if n in (*keys, order, y)]
    return rows.groupBy(*keys).applyInPandas(expanding(names, order, y, list(xs), min_train), schema)


def forecast_scores(forecasts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    def rmse(c: str) -> Column:
        return F.sqrt(F.avg(F.col(c) * F.col(c)))

    out = forecasts.groupBy(*keys).agg(
        rmse("error").alias("rmse"), rmse("benchmark_error").alias("benchmark_rmse"),
        F.count("*").alias("n_forecasts"), F.min(order).alias("first_forecast"), F.max(order).alias("last_forecast"),
    )
    return out.withColumn("ratio_to_mean", ratio("rmse", "benchmark_rmse"))


def loss_differentials(
    forecasts: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], candidate: str = "candidate"
) -> DataFrame:
    """Mean paired squared-error difference of each pair of candidates with its HAC error.

    Candidates are few and named, so their errors become columns of one row per
    period and the pairs come from that row.
    """
    sq = F.col("error") * F.col("error")
    wide = forecasts.groupBy(*keys, order).agg(
        *[F.max(F.when(F.col(candidate) == c, sq)).alias(f"_{c}") for c in names]
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    items = F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col(f"_{a}") - F.col(f"_{b}")).alias("d"),
                 F.col(f"_{a}").alias("_la"), F.col(f"_{b}").alias("_lb")) for a, b in pairs
    ])
    rows = wide.select(*keys, order, F.inline(items)).dropna(subset=["d"])
    k = [*keys, "first", "second"]
    scored = score(rows, ols(rows, k, "d", []), k, "d", [])
    test = hac(scored, k, order, [], {"const": {"const": 1.0}}).drop("term", "low", "high")
    losses = rows.groupBy(*k).agg(F.sqrt(F.avg("_la")).alias("_ra"), F.sqrt(F.avg("_lb")).alias("_rb"))
    out = test.join(losses, k).withColumnRenamed("coef", "mean_difference")
    return (
        out.withColumn("distinguishable", F.coalesce(F.abs("t") > Z95, F.lit(False)))
        .withColumn("better_rmse", F.least("_ra", "_rb"))
        .withColumn("worse_rmse", F.greatest("_ra", "_rb"))
        .drop("_ra", "_rb", "k")
    )


def with_power(pairs: DataFrame) -> DataFrame:
    """Power at the observed effect, the gap the test could have seen, and the sample it would take."""
    detectable = F.sqrt(F.col("better_rmse") * F.col("better_rmse") + Z95 * F.col("se"))
    effect = F.coalesce(F.abs("mean_difference") / F.when(F.col("se") > 0, F.col("se")), F.lit(0.0))
    need = F.pow((Z95 + Z_POWER_95) * F.col("se") / F.when(F.col("mean_difference") != 0, F.col("mean_difference")), 2)
    return (
        pairs.withColumn("observed_gap_percent", 100.0 * (F.col("worse_rmse") - F.col("better_rmse")) / F.col("worse_rmse"))
        .withColumn("detectable_gap_percent", 100.0 * (detectable - F.col("better_rmse")) / detectable)
        .withColumn("_effect", effect)
        .withColumn("power", normal_cdf(f"_effect - {Z95}") + normal_cdf(f"-_effect - {Z95}"))
        .drop("_effect")
        .withColumn("forecasts_needed", F.col("n") * need)
    )


def verdict(scores: DataFrame, pairs: DataFrame, keys: Sequence[str], candidate: str = "candidate") -> DataFrame:
    """Lowest RMSE per key, its lead, and whether any pair can be told apart."""
    ranked = scores.withColumn("rank", F.row_number().over(by(keys, "rmse", candidate)))
    best = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col(candidate))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("rmse"))).alias("best_rmse"),
        F.max(F.when(F.col("rank") == 2, F.col("rmse"))).alias("second_rmse"),
    )
    told = pairs.groupBy(*keys).agg(
        F.bool_or("distinguishable").alias("any_distinguishable"), F.count("*").alias("pairs")
    )
    lead = 100.0 * (F.col("second_rmse") - F.col("best_rmse")) / F.col("second_rmse")
    return best.join(told, list(keys)).withColumn("lead_percent", lead).withColumn(
        "verdict", F.when(F.col("any_distinguishable"), "ordering_informative").otherwise("cannot_tell_apart")
    )


# --- instrument and break --------------------------------------------------


def instrument(
    df: DataFrame, keys: Sequence[str], order: str, y: str, endo: str, inst: str, controls: Sequence[str], f_bar: float = 10.0
) -> DataFrame:
    """Two-stage least squares with one instrument, its first-stage F and the OLS beside it."""
    rows = df.dropna(subset=[y, endo, inst])
    first_x = [*controls, inst]
    first = score(rows, ols(rows, keys, endo, first_x), keys, endo, first_x)
    stage = hac(first, keys, order, first_x, single_terms([inst])).select(
        *keys, "n", F.col("coef").alias("first_coef"), F.col("se").alias("first_se")
    )
    ssr_first = quality_of_fit(first, keys, endo).select(*keys, F.col("ssr").alias("_ssr1"), F.col("r2").alias("first_r2"))
    reduced = score(rows, ols(rows, keys, endo, list(controls)), keys, endo, list(controls))
    ssr_reduced = quality_of_fit(reduced, keys, endo).select(*keys, F.col("ssr").alias("_ssr0"))

    second_x = [*controls, "_endo_hat"]
    hat = first.withColumn("_endo_hat", F.col("fitted")).drop("beta", "inv", "n", "k", "ybar", "nw_lag", "fitted", "resid")
    second_fit = ols(hat, keys, y, second_x)
    actual_x = [*controls, endo]
    second = hat.join(second_fit, list(keys)).withColumn("resid", F.col(y) - linear("beta", actual_x))
    iv = hac(second, keys, order, second_x, single_terms(["_endo_hat"])).select(
        *keys, F.col("coef").alias("iv_coef"), F.col("se").alias("iv_se")
    )
    plain = score(rows, ols(rows, keys, y, actual_x), keys, y, actual_x)
    ols_row = hac(plain, keys, order, actual_x, single_terms([endo])).select(
        *keys, F.col("coef").alias("ols_coef"), F.col("se").alias("ols_se")
    )
    out = stage
    for part in (ssr_first, ssr_reduced, iv, ols_row):
        out = out.join(part, list(keys))
    f = F.pow(F.col("first_coef") / F.when(F.col("first_se") > 0, F.col("first_se")), 2)
    return (
        out.withColumn("first_f", f)
        .withColumn("partial_r2", 1 - ratio("_ssr1", "_ssr0"))
        .withColumn("weak", ~F.coalesce(F.col("first_f") > f_bar, F.lit(False)))
        .drop("_ssr1", "_ssr0")
    )


def first_stage(df: DataFrame, keys: Sequence[str], order: str, endo: str, inst: str, controls: Sequence[str]) -> DataFrame:
    """Only the relevance half: coefficient, error, F and partial R2 of the instrument."""
    rows = df.dropna(subset=[endo, inst])
    xs = [*controls, inst]
    full = score(rows, ols(rows, keys, endo, xs), keys, endo, xs)
    out = hac(full, keys, order, xs, single_terms([inst]))
    a = quality_of_fit(full, keys, endo).select(*keys, F.col("ssr").alias("_s1"))
    small = score(rows, ols(rows, keys, endo, list(controls)), keys, endo, list(controls))
    b = quality_of_fit(small, keys, endo).select(*keys, F.col("ssr").alias("_s0"))
    out = out.join(a, list(keys)).join(b, list(keys))
    return out.withColumn("f", F.pow("t", F.lit(2))).withColumn("partial_r2", 1 - ratio("_s1", "_s0")).drop("_s1", "_s0")


def instrument_spread(df: DataFrame, keys: Sequence[str], period: str, inst: str, inside: Column) -> DataFrame:
    """Where the instrument moves: deviation inside and outside the episodes, its peak and when."""
    peak = F.when(F.col(inst).isNotNull(), F.struct((-F.col(inst)).alias("a"), F.col(period).alias("b")))
    return df.groupBy(*keys).agg(
        F.stddev_samp(F.when(inside, F.col(inst))).alias("sd_inside"),
        F.stddev_samp(F.when(~inside, F.col(inst))).alias("sd_outside"),
        F.max(inst).alias("peak"), F.min_by(period, peak).alias("peak_at"),
        F.count_if(inside).alias("periods_inside"),
    )


def break_residuals(
    df: DataFrame, keys: Sequence[str], period: str, y: str, xs: Sequence[str], first_post: str, min_post: int = 12
) -> DataFrame:
    """Fit before a date, predict after it. Residuals describe; a short sample gets no verdict."""
    rows = df.dropna(subset=[y, *xs])
    cut = F.lit(first_post).cast("date")
    pre, post = rows.filter(F.col(period) < cut), rows.filter(F.col(period) >= cut)
    fit = ols(pre, keys, y, xs)
    sd = score(pre, fit, keys, y, xs).groupBy(*keys).agg(F.stddev_samp("resid").alias("pre_sd"), F.count("*").alias("n_pre"))
    counts = post.groupBy(*keys).agg(F.count("*").alias("n_post"))
    out = score(post, fit, keys, y, xs).drop("n", "k", "inv", "beta", "ybar", "nw_lag").join(sd, list(keys)).join(counts, list(keys))
    return out.withColumn("resid_in_sd", ratio("resid", "pre_sd")).withColumn(
        "verdict", F.when(F.col("n_post") < min_post, "too_short").otherwise("reportable")
    )


