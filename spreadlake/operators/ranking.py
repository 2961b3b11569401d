"""Top-k, carriers, trailing ranks: deterministic tie rules, no global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.frames import by, keyed, unkeyed


def carrier(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """The largest contribution per key; a missing one never wins, ties go to the first name.

    ``min_by`` keeps one row per group on the map side, so no window or sort.
    """
    df, k = keyed(df, keys)
    present = F.col(value).isNotNull() & ~F.isnan(F.col(value))
    order = F.when(present, F.struct((-F.col(value)).alias("a"), F.col(name).alias("b")))
    best = F.min_by(F.struct(F.col(name).alias("carrier"), F.col(value).alias("carrier_value")), order)
    return unkeyed(keys, df.groupBy(*k).agg(best.alias("_b")).select(*k, "_b.carrier", "_b.carrier_value"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark keeps only k rows per group before the shuffle (window group limit)."""
    df, kk = keyed(df, keys)
    ranked = df.withColumn(rank, F.row_number().over(by(kk, *order)))
    return unkeyed(keys, ranked.filter(F.col(rank) <= k))


def extreme(df: DataFrame, keys: Sequence[str], value: str, period: str, largest: bool = True) -> DataFrame:
    """The extreme value and its period; the earliest period wins a tie."""
    df, k = keyed(df, keys)
    v = F.col(value) if largest else -F.col(value)
    order = F.when(F.col(value).isNotNull(), F.struct((-v).alias("a"), F.col(period).alias("b")))
    best = F.min_by(F.struct(F.col(value).alias("value"), F.col(period).alias("at")), order)
    return unkeyed(keys, df.groupBy(*k).agg(best.alias("_b")).select(*k, "_b.value", "_b.at"))


def latest(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """The latest observed row per key as value and period."""
    df, k = keyed(df.filter(F.col(value).isNotNull()), keys)
    return unkeyed(keys, df.groupBy(*k).agg(F.max(period).alias("at"), F.max_by(value, period).alias("value")))


def trailing_rank(
    df: DataFrame, keys: Sequence[str], period: str, value: str, months: int = 120, prefix: str = ""
) -> DataFrame:
    """Share of the trailing window's published values at or below this one, in percent.

    The window is months of the calendar, the current month included, missing
    months skipped. Each frame holds at most ``months`` monthly values.
    """
    df, k = keyed(df, keys)
    w = Window.partitionBy(*k).orderBy(cal.month_index(period)).rangeBetween(-(months - 1), 0)
    history = F.collect_list(value).over(w)
    out = df.withColumn("_h", history)
    at_or_below = F.size(F.filter("_h", lambda x: x <= F.col(value)))
    above = F.size(F.filter("_h", lambda x: x > F.col(value)))
    has = F.col(value).isNotNull() & (F.size("_h") > 0)
    return unkeyed(keys, 
        out.withColumn(f"{prefix}window_obs", F.size("_h"))
        .withColumn(f"{prefix}percentile", F.when(has, 100.0 * at_or_below / F.size("_h")))
        .withColumn(f"{prefix}rank_from_top", F.when(has, above + 1))
        .drop("_h")
    )


def gap_to_second(df: DataFrame, keys: Sequence[str], name: str, score: str) -> DataFrame:
    """Candidates ranked by a score where small is good, with the gap to the next one."""
    df, k = keyed(df, keys)
    w = by(k, score, name)
    nxt = F.lead(score).over(w)
    return unkeyed(keys, 
        df.withColumn("rank", F.row_number().over(w))
        .withColumn("gap", nxt - F.col(score))
        .withColumn("gap_percent", 100.0 * (nxt - F.col(score)) / nxt)
    )
