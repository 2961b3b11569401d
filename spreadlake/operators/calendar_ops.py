"""Calendar alignment: period means that never fill, spines, gaps, runs and clusters.

All of these first collapse raw rows to one row per (keys, period) with an
ordinary aggregate, so partial aggregation runs before the shuffle and a hot
key is reduced to its calendar length. The windows that follow see at most one
row per period of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.frames import by, keyed, unkeyed


def densify(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    grain: str,
    values: Sequence[str] = (),
    zeros: Sequence[str] = (),
) -> DataFrame:
    """One row per period between each key's first and last period.

    The hole after a row is generated from the row itself (``lead``), so the
    spine costs no join. ``values`` are NULL and ``zeros`` are 0 in a hole.
    """
    df, k = keyed(df, keys)
    df = df.withColumn("_next", F.lead(period).over(by(k, period)))
    last = F.coalesce(cal.shift("_next", grain, -1), F.col(period))
    spine = df.withColumn("_p", F.explode(F.sequence(F.col(period), last, cal.step(grain))))
    own = F.col("_p") == F.col(period)
    out = [F.col(c) for c in k] + [F.col("_p").alias(period)]
    out += [F.when(own, F.col(c)).alias(c) for c in values]
    out += [F.when(own, F.col(c)).otherwise(0).alias(c) for c in zeros]
    return unkeyed(keys, spine.select(*out))


def period_mean(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    min_obs: int = 15,
    grain: str = "monthly",
) -> DataFrame:
    """Mean of the published observations per period, NULL where the period is thin.

    The span runs over all dated rows, blank ones included; a period nothing
    was published in is kept with a count of zero.
    """
    df, k = keyed(df.filter(F.col(date).isNotNull()), keys)
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    agg = df.groupBy(*k, cal.anchor(date, grain).alias("period")).agg(
        F.avg(v).alias("value"), F.count(v).alias("observations")
    )
    dense = densify(agg, k, "period", grain, values=["value"], zeros=["observations"])
    return unkeyed(keys, 
        dense.withColumn("value", F.when(F.col("observations") >= min_obs, F.col("value")))
    )


def _periods(df: DataFrame, k: Sequence[str], date: str, grain: str) -> DataFrame:
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(*k, cal.anchor(date, grain).alias("period"))
        .agg(F.count("*").alias("_n"))
    )


def gaps(df: DataFrame, keys: Sequence[str], date: str, grain: str) -> DataFrame:
    """Periods with no observation strictly between a key's first and last one.

    Daily means weekdays; a weekly observation counts for its Monday.
    """
    df, k = keyed(df, keys)
    base = _periods(df, k, date, grain).withColumn("_next", F.lead("period").over(by(k, "period")))
    first, last = cal.shift("period", grain, 1), cal.shift("_next", grain, -1)
    holes = base.filter(F.col("_next") > first).select(
        *k, F.explode(F.sequence(first, last, cal.step(grain))).alias("gap")
    )
    if grain == "daily":
        holes = holes.filter(cal.is_weekday("gap"))
    return unkeyed(keys, holes)


def expected_minus_present(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected periods that are not present."""
    return expected.select(*on).distinct().join(present.select(*on), list(on), "left_anti")


def runs_of(
    df: DataFrame, keys: Sequence[str], period: str, flag: Column, grain: str | None = None
) -> DataFrame:
    """Contiguous runs of True: first, last, length.

    With ``grain=None`` neighbours are neighbouring rows; with ``"monthly"``
    they are neighbouring calendar months, so a missing month ends a run.
    """
    df, k = keyed(df, keys)
    w = by(k, period)
    position = F.row_number().over(w) if grain is None else cal.month_index(period)
    true_rows = df.withColumn("_pos", position).withColumn("_f", flag).filter(F.col("_f"))
    grouped = true_rows.withColumn("_run", F.col("_pos") - F.row_number().over(w))
    return unkeyed(keys, 
        grouped.groupBy(*k, "_run")
        .agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count("*").alias("length"))
        .drop("_run")
    )


def longest_run(df: DataFrame, keys: Sequence[str], period: str, flag: Column, grain: str | None = "monthly") -> DataFrame:
    """The longest run per key; the earliest wins a tie."""
    df, k = keyed(df, keys)
    runs = runs_of(df, k, period, flag, grain)
    best = F.min_by(F.struct("first", "last", "length"), F.struct(-F.col("length"), F.col("first")))
    return unkeyed(keys, runs.groupBy(*k).agg(best.alias("_b")).select(*k, "_b.*"))


def value_timeline(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Contiguous stretches of one value over the rows that carry one."""
    df, k = keyed(df.filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")), keys)
    w = by(k, period)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    cut = df.withColumn("_c", change).withColumn("_stretch", F.sum("_c").over(w))
    return unkeyed(keys, 
        cut.groupBy(*k, "_stretch", value)
        .agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count("*").alias("periods"))
        .drop("_stretch")
    )


def gap_clusters(df: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Cluster values whose consecutive gaps stay within the tolerance.

    Rows are first collapsed into cells no wider than the tolerance. Two values
    of one cell always belong together, so only the gap between one cell's
    largest and the next cell's smallest value is left to compare, and the
    window sees at most span / tolerance cells per key however many rows the
    key holds.
    """
    df, k = keyed(df, keys)
    cells = df.groupBy(*k, F.floor(F.col(value) / F.lit(float(tolerance))).alias("_cell")).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    w = by(k, "_cell")
    new = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > tolerance).cast("int"), F.lit(1))
    cut = cells.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w))
    return unkeyed(keys, 
        cut.groupBy(*k, "cluster").agg(
            F.min("_lo").alias("first"),
            F.max("_hi").alias("last"),
            F.sum("_n").alias("members"),
            (F.sum("_s") / F.sum("_n")).alias("centre"),
        )
    )


def spine_from_last(df: DataFrame, last: Column, position: Column, count: Column, pitch_days: int = 7) -> DataFrame:
    """Dates for ``count`` equally spaced points ending at ``last``; position starts at 0."""
    back = (count - 1 - position) * pitch_days
    return df.withColumn("date", F.date_sub(last, back.cast("int")))


def corroboration_bounds(df: DataFrame, keys: Sequence[str], period: str, n_sources: str) -> DataFrame:
    """First and last period with more than one independent source, per key."""
    df, k = keyed(df, keys)
    p = F.when(F.col(n_sources) > 1, F.col(period))
    return unkeyed(keys, df.groupBy(*k).agg(F.min(p).alias("first_corroborated"), F.max(p).alias("last_corroborated")))


# The words for how far a period's value is supported.
UNCOVERED, SUPPORTED = "no_coverage", "cross_checked"
OLDEST, INTERIOR, NEWEST = "single_geometry_oldest", "single_geometry_interior", "single_geometry_newest"


def evidence_class(period: Column, n_notes: Column, n_sources: Column, first: Column, last: Column) -> Column:
    """What stands behind a value: nothing, several sources, or one, and then on which side of those supported."""
    some = F.coalesce(n_notes > 0, F.lit(False))
    return (
        F.when(~some, UNCOVERED).when(n_sources > 1, SUPPORTED)
        .when(period > last, NEWEST).when(period < first, OLDEST).otherwise(INTERIOR)
    )
