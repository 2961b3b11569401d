"""Threshold search on a kinked line: profile, bootstrap, verdict.

Between two neighbouring values of x the rows below the threshold are the same,
and what the kinked regressor max(tau - x, 0) explains is a ratio of quadratics
in tau, written with the running co-moments of those rows:

    gain(tau) = (ty * t - sxy)^2 / (sxx + n * (1 - n / N) * t^2),  t = tau - mean x

Such a ratio has one turning point besides its zero, so the best candidate of a
gap is its first, its last or a neighbour of that point. A search looks at four
candidates per gap, however fine the grid; a profile lists them all. Co-moments
are taken about running means. Where one value or all of them lie below, the
ratio does not depend on tau: all candidates explain alike, and the first wins.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.functions.frames import by
from spreadlake.functions.numeric import ratio
from spreadlake.operators import calendar_ops, regress

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 0.25
QUANTILES = (0.05, 0.95)


def autocorrelation(df: DataFrame, keys: Sequence[str], period: str, value: str, max_lag: int | None = None) -> DataFrame:
    """Autocorrelations 1..max_lag, divide-by-n form; by default up to min(n / 4, 36)."""
    top = max_lag or 36
    rows = df.filter(F.col(value).isNotNull())
    whole = Window.partitionBy(*keys)
    centred = rows.select(*keys, period, (F.col(value) - F.avg(value).over(whole)).alias("_x"))
    w = by(keys, period)
    lagged = centred.select(*keys, "_x", *[(F.col("_x") * F.lag("_x", n).over(w)).alias(f"_p{n}") for n in range(1, top + 1)])
    sums = lagged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_ss"),
        *[F.sum(f"_p{n}").alias(f"_p{n}") for n in range(1, top + 1)],
    )
    items = F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"_p{n}").alias("_s")) for n in range(1, top + 1)])
    long = sums.select(*keys, "n", "_ss", F.inline(items))
    limit = F.lit(max_lag) if max_lag else F.greatest(F.lit(1), F.least(F.floor(F.col("n") / 4), F.lit(36)))
    kept = long.filter(F.col("lag") <= limit)
    return kept.select(*keys, "n", "lag", ratio(F.coalesce("_s", F.lit(0.0)), "_ss").alias("acf"))


def block_length(df: DataFrame, keys: Sequence[str], period: str, value: str, max_lag: int | None = None) -> DataFrame:
    """The first lag inside the two over root n band, else the longest lag looked at."""
    acf = autocorrelation(df, keys, period, value, max_lag)
    inside = F.when(F.abs("acf") < 2 / F.sqrt("n"), F.col("lag"))
    return acf.groupBy(*keys).agg(F.coalesce(F.min(inside), F.max("lag")).alias("block"))


def grid(df: DataFrame, keys: Sequence[str], x: str, quantiles: tuple[float, float] = QUANTILES, step: float = STEP) -> DataFrame:
    """Per key: lowest candidate and how many steps fit below the upper quantile.

    Rows are one per period, so an exact percentile holds one calendar per key.
    """
    ends = df.groupBy(*keys).agg(F.percentile(x, quantiles[0]).alias("lo"), F.percentile(x, quantiles[1]).alias("hi"))
    return ends.filter(F.col("hi") > F.col("lo")).withColumn(
        "cells", F.floor((F.col("hi") - F.col("lo")) / step).cast("int") + 1
    )


def _gaps(df: DataFrame, keys: Sequence[str], x: str, y: str, bounds: DataFrame, step: float) -> DataFrame:
    """One row per key and gap between neighbouring values: its candidates ``first`` to ``last`` and the moments of the rows below."""
    upto = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ordered, whole = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys)
    rows = df.select(
        *keys, F.col(x).alias("_x"), F.count("*").over(upto).alias("b_n"), F.avg(x).over(upto).alias("b_mx"),
        (F.count("*").over(upto) * F.var_pop(x).over(upto)).alias("b_sxx"), (F.count("*").over(upto) * F.covar_pop(x, y).over(upto)).alias("b_sxy"),
        (F.count("*").over(upto) * (F.avg(y).over(upto) - F.avg(y).over(whole))).alias("b_ty"), F.dense_rank().over(ordered).alias("b_values"),
        F.count("*").over(whole).alias("n"), (F.count("*").over(whole) * F.var_pop(y).over(whole)).alias("syy"), F.lead(x).over(ordered).alias("_next"),
    ).filter(F.col("_next").isNull() | (F.col("_next") > F.col("_x"))).join(bounds, list(keys))
    cell = lambda c: F.floor((F.col(c) - F.col("lo")) / step).cast("int")
    top = F.col("cells") - 1
    above = rows.withColumn("first", F.greatest(cell("_x") + 1, F.lit(0))).withColumn("last", F.least(F.coalesce(cell("_next"), top), top))
    # below the lowest value there is no row and nothing is explained
    none = {c: F.lit(0.0) for c in ("b_sxx", "b_sxy", "b_ty")} | {c: F.lit(0).cast("bigint") for c in ("b_n",)}
    lowest = rows.filter("b_values = 1").withColumns(none).withColumn("first", F.lit(0)).withColumn("last", F.least(cell("_x"), top))
    return above.unionByName(lowest).filter("first <= last").drop("_next")


def _gain(i: Column, step: float) -> Column:
    """What candidate ``i`` of a gap explains of the sum of squares."""
    t = F.col("lo") + i * F.lit(float(step)) - F.col("b_mx")
    w = F.col("b_n") * (1 - F.col("b_n") / F.col("n"))
    shh = F.col("b_sxx") + w * t * t
    shy = F.col("b_ty") * t - F.col("b_sxy")
    some = (F.col("b_n") > 0) & (shh > 1e-9)
    line = F.when(some & (F.col("b_n") == F.col("n")), F.col("b_sxy") * F.col("b_sxy") / F.col("b_sxx"))
    return line.when(some & (F.col("b_values") == 1), F.col("b_ty") * F.col("b_ty") / w).when(some, shy * shy / shh).otherwise(F.lit(0.0))


def profile(
    df: DataFrame, keys: Sequence[str], x: str, y: str, quantiles: tuple[float, float] = QUANTILES, step: float = STEP, bounds: DataFrame | None = None
) -> DataFrame:
    """SSR of the kinked fit at every candidate threshold of every key."""
    rows = df.dropna(subset=[x, y])
    gaps = _gaps(rows, keys, x, y, grid(rows, keys, x, quantiles, step) if bounds is None else bounds, step)
    each = gaps.select("*", F.explode(F.sequence("first", "last")).alias("i"))
    ssr = F.col("syy") - _gain(F.col("i"), step)
    return each.select(*keys, "i", (F.col("lo") + F.col("i") * F.lit(float(step))).alias("tau"), ssr.alias("ssr"), "n")


def search(
    df: DataFrame, keys: Sequence[str], x: str, y: str, quantiles: tuple[float, float] = QUANTILES, step: float = STEP, bounds: DataFrame | None = None
) -> DataFrame:
    """The candidate with the smallest SSR, the first of equals, from four candidates per gap."""
    rows = df.dropna(subset=[x, y])
    gaps = _gaps(rows, keys, x, y, grid(rows, keys, x, quantiles, step) if bounds is None else bounds, step)
    w = F.col("b_n") * (1 - F.col("b_n") / F.col("n"))
    turn = F.col("b_mx") - F.col("b_ty") * F.col("b_sxx") / F.nullif(w * F.col("b_sxy"), F.lit(0.0))
    # held inside the gap before it becomes a whole number
    near = F.floor(F.least(F.greatest((turn - F.col("lo")) / step, F.col("first").cast("double")), F.col("last").cast("double"))).cast("int")
    tried = F.array("first", "last", F.coalesce(near, F.col("first")), F.least(F.coalesce(near, F.col("first")) + 1, F.col("last")))
    each = gaps.select("*", F.explode(F.array_distinct(tried)).alias("i"))
    best = F.min(F.struct((F.col("syy") - _gain(F.col("i"), step)).alias("ssr"), F.col("i")))
    found = each.groupBy(*keys).agg(best.alias("_b"), F.max("n").alias("n"), F.max("lo").alias("grid_low"), F.max("cells").alias("cells"))
    return found.select(
        *keys, (F.col("grid_low") + F.col("_b.i") * F.lit(float(step))).alias("tau"), F.col("_b.ssr").alias("ssr"), "n", "grid_low",
        (F.col("grid_low") + (F.col("cells") - 1) * F.lit(float(step))).alias("grid_high"),
    )


def kink_fit(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, points: DataFrame) -> DataFrame:
    """Level and slope below a fixed threshold, with HAC error and the linear fit it competes with."""
    rows = df.dropna(subset=[x, y]).join(points.select(*keys, "tau"), list(keys))
    rows = rows.withColumn("shortfall", F.greatest(F.col("tau") - F.col(x), F.lit(0.0)))
    scored = regress.score(rows, regress.ols(rows, keys, y, ["shortfall"]), keys, y, ["shortfall"])
    fit = regress.hac(scored, keys, order, ["shortfall"], {"level": {"const": 1.0}, "below": {"shortfall": -1.0}})
    wide = fit.groupBy(*keys).agg(
        F.max(F.when(F.col("term") == "level", F.col("coef"))).alias("level"),
        F.max(F.when(F.col("term") == "below", F.col("coef"))).alias("slope_below"),
        F.max(F.when(F.col("term") == "below", F.col("se"))).alias("slope_below_se"),
    )
    quality = regress.quality_of_fit(scored, keys, y).select(*keys, "ssr", "r2")
    below = F.col(x) < F.col("tau")
    side = rows.groupBy(*keys).agg(
        F.max("tau").alias("tau"), F.count("*").alias("n"), F.count_if(below).alias("months_below"),
        F.avg(F.when(below, F.col(y))).alias("mean_below"), F.avg(F.when(~below, F.col(y))).alias("mean_above"),
        F.regr_r2(F.col(y), F.col(x)).alias("linear_r2"),
        (F.regr_syy(F.col(y), F.col(x)) * (1 - F.regr_r2(F.col(y), F.col(x)))).alias("linear_ssr"),
    )
    return side.join(wide, list(keys)).join(quality, list(keys))


MODULUS = 2147483648


#: Replicates that one task resamples at a time.
CHUNK = 250


def bootstrap_draws(
    df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, blocks: DataFrame, bounds: DataFrame,
    replications: int = 2000, seed: int = 62, step: float = STEP,
) -> DataFrame:
    """The threshold of every moving-block resample, on the grid of the original sample.

    One row is a period, so a key's series is as long as its calendar. A resample is how often each
    row is taken, a whole number; a task gets the series and a chunk of replicates, walks once over
    the values from the lowest and keeps the moments of all its replicates. No replicate is ever
    joined to rows and no candidate is looked at but the four of a gap.
    """
    rows = df.dropna(subset=[x, y]).join(bounds, list(keys)).select(*keys, F.col(order), F.col(x).alias("_x"), F.col(y).alias("_y"), "lo", "cells")
    numbered = rows.withColumn("_pos", F.row_number().over(by(keys, order)) - 1)
    numbered = numbered.select(*keys, "_pos", "_x", "_y", "lo", "cells").join(blocks, list(keys))
    chunks = F.sequence(F.lit(0), F.lit((replications - 1) // CHUNK))
    spread = numbered.withColumn("_chunk", F.explode(chunks))
    names = list(keys)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        first = int(pdf["_chunk"].iloc[0]) * CHUNK
        rep = np.arange(first, min(first + CHUNK, replications))
        lo, cells = float(pdf["lo"].iloc[0]), int(pdf["cells"].iloc[0])
        taken = multiplicities(block_positions(len(pdf), int(pdf["block"].iloc[0]), rep, seed), len(pdf))
        best = best_candidates(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), taken, lo, cells, step)
        out = pd.DataFrame({"rep": rep, "tau": lo + step * best})
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return spread.groupBy(*keys, "_chunk").applyInPandas(resample, f"{kinds}, rep int, tau double")


def block_positions(n: int, block: int, rep: np.ndarray, seed: int) -> np.ndarray:
    """Positions of every replicate: blocks of neighbours, the last one cut to the length of the series."""
    block = min(block, n)
    j = np.arange(-(-n // block), dtype=np.int64)
    u = (rep.astype(np.int64)[:, None] * 1103515245 + (j + 1) * 12345 + seed * 69069) % MODULUS
    v = ((u + (j + 1) * 40503) * 1103515245 + 12345) % MODULUS
    start = v // 256 % (n - block + 1)
    return (start[:, :, None] + np.arange(block)).reshape(len(rep), -1)[:, :n]


def multiplicities(at: np.ndarray, n: int) -> np.ndarray:
    """How often each replicate (a row) takes each of ``n`` positions."""
    reps = len(at)
    return np.bincount((np.arange(reps)[:, None] * n + at).ravel(), minlength=reps * n).reshape(reps, n)


def best_candidates(x: np.ndarray, y: np.ndarray, taken: np.ndarray, lo: float, cells: int, step: float) -> np.ndarray:
    """Index of the best candidate of every replicate, the first one of equals."""
    order = np.argsort(x, kind="stable")
    x, y, taken = x[order], y[order], taken[:, order].astype(float)
    total = taken.sum(axis=1)
    mean_y = taken @ y / total
    n = np.zeros(len(taken))
    mx, my, sxx, sxy = (np.zeros(len(taken)) for _ in range(4))
    best, gain = np.zeros(len(taken), np.int64), np.zeros(len(taken))
    for k in range(len(x)):
        m = taken[:, k]
        n += m
        share = m / np.maximum(n, 1)
        dx = x[k] - mx
        mx = mx + share * dx
        sxx += m * dx * (x[k] - mx)
        dy = y[k] - my
        my = my + share * dy
        sxy += m * (x[k] - mx) * dy
        if k + 1 < len(x) and x[k + 1] == x[k]:
            continue
        first = max(int(np.floor((x[k] - lo) / step)) + 1, 0)
        last = cells - 1 if k + 1 == len(x) else min(int(np.floor((x[k + 1] - lo) / step)), cells - 1)
        if first > last:
            continue
        w, ty = n * (1 - n / total), n * (my - mean_y)
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = (mx - ty * sxx / (w * sxy) - lo) / step
        near = np.floor(np.clip(np.where(np.isfinite(turn), turn, first), first, last)).astype(np.int64)
        for i in (np.full(len(n), first), near, np.minimum(near + 1, last), np.full(len(n), last)):
            t = lo + step * i - mx
            shh, shy = sxx + w * t * t, ty * t - sxy
            some = (n > 0) & (shh > 1e-9)
            alike = some & (sxx == 0) & (w > 0)
            own = np.where(alike, ty * ty / np.where(w > 0, w, 1), np.where(some, shy * shy / np.where(some, shh, 1), 0))
            own = np.where(some & (n == total), sxy * sxy / np.where(sxx > 0, sxx, 1), own)
            # candidates come in rising order, so an equal one later never wins
            better = own > gain
            best, gain = np.where(better, i, best), np.where(better, own, gain)
    return best


def verdict(
    df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, replications: int = 2000, seed: int = 62,
    max_width: float = 10.0, quantiles: tuple[float, float] = QUANTILES, step: float = STEP, max_lag: int | None = None, min_months: int = 24,
) -> DataFrame:
    """Point, bootstrap interval, and whether the sample identifies a threshold at all.

    A sample of fewer than ``min_months`` periods identifies nothing, whatever its interval.
    """
    rows = df.dropna(subset=[x, y])
    bounds = grid(rows, keys, x, quantiles, step)
    point = search(rows, keys, x, y, quantiles, step, bounds)
    blocks = block_length(rows, keys, order, y, max_lag)
    draws = bootstrap_draws(rows, keys, order, x, y, blocks, bounds, replications, seed, step)
    interval = draws.groupBy(*keys).agg(F.percentile("tau", 0.025).alias("ci_low"), F.percentile("tau", 0.975).alias("ci_high"))
    fit = kink_fit(rows, keys, order, x, y, point).drop("ssr", "n")
    out = point.drop("n").join(fit.drop("tau"), list(keys)).join(interval, list(keys)).join(blocks, list(keys))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    marked = rows.join(point.select(*keys, "tau"), list(keys))
    run = calendar_ops.longest_run(marked, keys, order, F.col(x) < F.col("tau")).select(
        *keys, F.col("first").alias("run_first"), F.col("last").alias("run_last"), F.col("length").alias("run_length")
    )
    wide = F.col("ci_high") - F.col("ci_low") > max_width
    low = F.col("ci_low") <= F.col("grid_low") + step
    high = F.col("ci_high") >= F.col("grid_high") - step
    reasons = F.array_compact(F.array(
        F.when(F.col("n") < min_months, "too_few_months"), F.when(wide, "interval_too_wide"), F.when(low, "touches_lower_edge"), F.when(high, "touches_upper_edge")
    ))
    return (
        out.join(counted, list(keys)).join(run, list(keys), "left")
        .withColumn("reasons", reasons).withColumn("identified", F.size("reasons") == 0)
    )


def grid_sensitivity(
    df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, sets: Mapping[str, tuple[float, float]],
    replications: int, seed: int = 62, max_width: float = 10.0, step: float = STEP, max_lag: int | None = None,
) -> DataFrame:
    """The verdict under several grids; each quantile pair is a key of the same job."""
    rows = df.dropna(subset=[x, y]).withColumn("grid_set", F.explode(F.array(*[F.lit(s) for s in sets])))
    k = [*keys, "grid_set"]
    ends = rows.groupBy(*k).agg(F.percentile(x, F.array(*[F.lit(q) for pair in sets.values() for q in pair])).alias("_q"))
    pick_lo = F.coalesce(*[F.when(F.col("grid_set") == s, F.col("_q")[2 * i]) for i, s in enumerate(sets)])
    pick_hi = F.coalesce(*[F.when(F.col("grid_set") == s, F.col("_q")[2 * i + 1]) for i, s in enumerate(sets)])
    bounds = ends.select(*k, pick_lo.alias("lo"), pick_hi.alias("hi")).filter(F.col("hi") > F.col("lo")).withColumn(
        "cells", F.floor((F.col("hi") - F.col("lo")) / step).cast("int") + 1
    )
    point = search(rows, k, x, y, step=step, bounds=bounds)
    blocks = block_length(rows, k, order, y, max_lag)
    draws = bootstrap_draws(rows, k, order, x, y, blocks, bounds, replications, seed, step)
    interval = draws.groupBy(*k).agg(F.percentile("tau", 0.025).alias("ci_low"), F.percentile("tau", 0.975).alias("ci_high"))
    out = point.join(interval, k).withColumn("ci_width", F.col("ci_high") - F.col("ci_low"))
    too_wide = F.col("ci_width") > max_width
    edge = (F.col("ci_low") <= F.col("grid_low") + step) | (F.col("ci_high") >= F.col("grid_high") - step)
    return out.withColumn("too_wide", too_wide).withColumn("touches_edge", edge).withColumn("identified", ~too_wide & ~edge)
