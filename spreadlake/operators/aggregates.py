"""Aggregates over revised readings, exact quantiles that survive a hot group, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.functions.frames import by, keyed, unkeyed
from spreadlake.functions.numeric import ratio, strict_sum
from spreadlake.operators.calendar_ops import densify
from spreadlake.session import cut_lineage, stored_dimension


#: Distinct values of one bucket that a task may have to order.
SLICE_VALUES = 50_000

#: Parts a bucket is cut into when it holds more.
PARTS = 4096


def _octave(v: Column) -> Column:
    """Sign and power of two of a double as one rising number; NaN is the largest, as it is in an order."""
    power = F.least(F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1075)), F.lit(1024)) + 1100
    return F.when(F.isnan(v), 5000).when(v == 0, 0).otherwise(F.signum(v) * power).cast("int")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], slice_values: int = SLICE_VALUES
) -> DataFrame:
    """Interpolated quantiles per key, exact, without holding a group in one task.

    Equal values are counted first, in the one pass over the rows, and the counts are stored. A
    histogram by sign and power of two, which partial counts merge into, tells in which bucket each
    wanted rank lies; only those buckets go on. One that holds more than ``slice_values`` distinct
    values is cut into ``PARTS`` equal parts between its ends and looked at again; a power of two has
    2**52 doubles, so that ends after five rounds at most. The values of the last buckets are ordered.
    A row costs one number per round, however many values or buckets there are.
    """
    df, k = keyed(df.filter(F.col(value).isNotNull()), keys)
    counts = df.groupBy(*k, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    rows = cut_lineage(counts, "quantile-counts").withColumn("_at", F.lit(0).cast("bigint")).withColumn("_b", _octave(F.col("_v")))
    first = rows.groupBy(*k, "_at", "_b").agg(
        F.sum("_c").alias("_sc"), F.count("*").alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    hist = cut_lineage(first, "quantile-octaves")
    # every wanted quantile needs the two ranks around its position
    wanted = F.array(*[F.struct(F.lit(name).alias("_q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("_pos")) for name, q in quantiles.items()])
    ranks = hist.groupBy(*k).agg(F.sum("_sc").alias("_n")).select(*k, F.inline(wanted)).withColumn(
        "_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos"))))
    )
    for step in range(1, 8):
        before = by([*k, "_at"], "_b").rowsBetween(Window.unboundedPreceding, -1)
        located = hist.withColumn("_start", F.col("_at") + F.coalesce(F.sum("_sc").over(before), F.lit(0)))
        held = located.join(ranks.select(*k, "_rank"), k).filter(F.col("_rank").between(F.col("_start"), F.col("_start") + F.col("_sc") - 1))
        active = cut_lineage(held.drop("_rank", "_sc").distinct(), f"quantile-active-{step}")
        most = active.agg(F.max("_values")).first()[0] or 0
        rows = rows.select(*k, "_v", "_c", "_at", "_b").join(active, [*k, "_at", "_b"]).drop("_at", "_b").withColumnRenamed("_start", "_at")
        if most <= slice_values:
            break
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS).cast("int")
        rows = cut_lineage(rows.withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), part).otherwise(F.lit(0))), f"quantile-rows-{step}")
        hist = rows.groupBy(*k, "_at", "_b").agg(
            F.sum("_c").alias("_sc"), F.count("*").alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
    w = by([*k, "_at"], "_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = rows.withColumn("_end", F.col("_at") + F.sum("_c").over(w)).select(*k, "_v", "_end", (F.col("_end") - F.col("_c")).alias("_from"))
    hit = ordered.join(ranks, k).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_end")))
    share = F.col("_pos") - F.floor("_pos")
    weight = F.when(F.floor("_pos") == F.ceil("_pos"), F.lit(1.0)).when(
        F.col("_rank") == F.floor("_pos"), 1 - share
    ).otherwise(share)
    per_q = hit.groupBy(*k, "_q").agg(F.sum(weight * F.col("_v")).alias("_x"))
    return unkeyed(keys, 
        per_q.groupBy(*k).agg(*[F.max(F.when(F.col("_q") == name, F.col("_x"))).alias(name) for name in quantiles])
    )


def readings_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and spread across readings; the spread of one reading is undefined."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.when(F.count(value) > 1, F.max(value) - F.min(value)).alias("spread")
    )
    return base.join(exact_quantiles(df, keys, value, {"median": 0.5}), list(keys), "left")


def respecification(
    df: DataFrame, keys: Sequence[str], slot: str, spec: str, value: str
) -> DataFrame:
    """Disagreement within one specification kept apart from gaps across specifications.

    Three aggregates of falling size: (keys, slot, spec), (keys, slot), (keys).
    """
    per_spec = df.filter(F.col(value).isNotNull()).groupBy(*keys, slot, spec).agg(
        F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    within = F.max(F.when(F.col("_n") > 1, F.col("_hi") - F.col("_lo")))
    per_slot = per_spec.groupBy(*keys, slot).agg(
        within.alias("_within"),
        F.when(F.count("*") > 1, F.max("_hi") - F.min("_lo")).alias("_across"),
        F.array_join(F.array_sort(F.collect_set(spec)), "|").alias("_specs"),
    )
    named = F.when(F.col("_across").isNotNull(), F.concat(F.col(slot), F.lit(":"), F.col("_specs")))
    return per_slot.groupBy(*keys).agg(
        F.max("_within").alias("max_disagreement"),
        F.max("_across").alias("max_respec_gap"),
        F.array_join(F.array_sort(F.collect_list(named)), ";").alias("respecified"),
    )


def calibrate(df: DataFrame, doc: str, decoded: str, printed: str, limit: float) -> DataFrame:
    """One additive offset per document, its residuals, and whether the worst one passes."""
    gap = F.col(printed) - F.col(decoded)
    offsets = df.groupBy(doc).agg(
        F.avg(gap).alias("offset"), F.stddev_pop(gap).alias("offset_sd"), F.count(gap).alias("anchors")
    )
    after = F.abs(F.col(decoded) + F.col("offset") - F.col(printed))
    offsets = stored_dimension(offsets, "offsets")
    residuals = df.join(offsets.select(doc, "offset"), doc).groupBy(doc).agg(
        F.avg(after).alias("mae"), F.max(after).alias("worst")
    )
    return offsets.join(residuals, doc).withColumn("accepted", F.col("worst") <= limit)


def leave_one_series_out(df: DataFrame, doc: str, series: str, decoded: str, printed: str) -> DataFrame:
    """Offset refitted without each series and scored on it: totals less the part, no refit loop."""
    gap = F.col(printed) - F.col(decoded)
    part = df.groupBy(doc, series).agg(F.sum(gap).alias("_ps"), F.count(gap).alias("_pn"))
    total = part.groupBy(doc).agg(F.sum("_ps").alias("_ts"), F.sum("_pn").alias("_tn"))
    fitted = part.join(total, doc).select(
        doc, series, ratio(F.col("_ts") - F.col("_ps"), F.col("_tn") - F.col("_pn")).alias("_fit")
    )
    fitted = stored_dimension(fitted, "refits")
    err = F.abs(F.col(decoded) + F.col("_fit") - F.col(printed))
    return df.join(fitted, [doc, series]).groupBy(doc).agg(F.avg(err).alias("oos_mae"), F.max(err).alias("oos_worst"))


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per key and its largest residual; equal positions have no line."""
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n")
    )
    resid = F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    fit = stored_dimension(fit, "lines")
    worst = df.join(fit, list(keys)).groupBy(*keys).agg(F.max(resid).alias("worst_residual"))
    return fit.join(worst, list(keys), "left").withColumn("usable", F.col("slope").isNotNull())


def wide_by_area(
    df: DataFrame, keys: Sequence[str], period: str, area: str, value: str, areas: Sequence[str], code: str, codes: Sequence[str]
) -> DataFrame:
    """Long to wide on a gap-free spine with a strict total and counts of cells and codes."""
    cells = df.groupBy(*keys, period, area).agg(F.sum(value).alias("_v"), F.count(value).alias("_c"))
    wide = cells.groupBy(*keys, period).agg(
        *[F.max(F.when(F.col(area) == a, F.col("_v"))).alias(a) for a in areas],
        strict_sum(F.when(F.col(area).isin(*areas), F.col("_v")), len(areas)).alias("total"),
        F.sum("_c").alias("cells"),
    )
    coded = df.groupBy(*keys, period).agg(*[F.count_if(F.col(code) == c).alias(f"cells_code_{c}") for c in codes])
    joined = wide.join(coded, [*keys, period])
    return densify(
        joined, keys, period, "monthly", values=[*areas, "total"], zeros=["cells", *[f"cells_code_{c}" for c in codes]]
    )


def flagged_cells(df: DataFrame, code: str, flagged: Sequence[str]) -> DataFrame:
    return df.filter(F.col(code).isin(*flagged))


def layer_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Two layers of one series over the periods both hold: mean gap, mean absolute gap, correlation."""
    j = a.select(*keys, period, F.col(value).alias("_a")).join(b.select(*keys, period, F.col(value).alias("_b")), [*keys, period])
    j = j.dropna(subset=["_a", "_b"])
    return j.groupBy(*keys).agg(
        F.count("*").alias("periods"),
        F.avg(F.col("_a") - F.col("_b")).alias("mean_gap"),
        F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_abs_gap"),
        F.corr("_a", "_b").alias("corr"),
    )


def implied_ratio(a: DataFrame, b: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Ratio of two layers per shared period: count, first, last, mean, min, max."""
    j = a.select(*keys, period, F.col(value).alias("_a")).join(b.select(*keys, period, F.col(value).alias("_b")), [*keys, period])
    j = j.withColumn("_r", ratio("_a", "_b")).dropna(subset=["_r"])
    return j.groupBy(*keys).agg(
        F.count("*").alias("periods"), F.min(period).alias("first"), F.max(period).alias("last"),
        F.avg("_r").alias("mean"), F.min("_r").alias("min"), F.max("_r").alias("max"),
    )


def expected_vs_observed(observed: DataFrame, expected: DataFrame, on: Sequence[str], value: str, places: int = 3) -> DataFrame:
    """Observed against expected with agreement after half-even rounding."""
    out = expected.join(observed.select(*on, value), list(on), "left")
    return out.withColumn("difference", F.col(value) - F.col("expected")).withColumn(
        "agrees", F.coalesce(F.bround(F.col(value), places) == F.col("expected"), F.lit(False))
    )


def specification_list(df: DataFrame, keys: Sequence[str], spec: str, period: str) -> DataFrame:
    """Distinct specifications in order of first appearance, with their first period."""
    df, k = keyed(df.filter(F.col(spec).isNotNull()), keys)
    first = df.groupBy(*k, spec).agg(F.min(period).alias("first"))
    return unkeyed(keys, first.withColumn("position", F.row_number().over(by(k, "first", spec))))


def range_summary(df: DataFrame, keys: Sequence[str], period: str, value: str, official: str) -> DataFrame:
    """Min, max, latest, mean gap and the largest gap with its period."""
    gap = F.col(official) - F.col(value)
    present = F.when(F.col(value).isNotNull(), F.col(period))
    worst = F.when(gap.isNotNull(), F.struct((-F.abs(gap)).alias("a"), F.col(period).alias("b")))
    return df.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, present).alias("latest"),
        F.avg(gap).alias("mean_gap"), F.min_by(gap, worst).alias("max_gap"), F.min_by(period, worst).alias("max_gap_at"),
    )
