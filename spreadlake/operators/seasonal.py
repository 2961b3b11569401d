"""Seasonal bands, demeaned shapes and the season claim check, per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.frames import keyed, unkeyed
from spreadlake.operators.regress import Z95

SUMMER = ((0, 4), (0, 5), (0, 6), (0, 7), (0, 8))
WINTER = ((0, 11), (0, 12), (1, 1), (1, 2), (1, 3))


def _year_slot(period: str, grain: str) -> tuple[Column, Column, int]:
    if grain == "monthly":
        return F.year(period), F.month(period), 12
    if grain == "weekly":
        return cal.iso_year(period), cal.iso_week(period), 53
    raise ValueError(f"a seasonal band is monthly or weekly, not {grain!r}")


def prior_years(df: DataFrame, keys: Sequence[str], excluded: Sequence[int], range_years: int) -> DataFrame:
    """Rows (keys, _year, ...) tagged ``prior`` or ``current``; other years go.

    The window is the last ``range_years`` years that survive the exclusions.
    """
    w = Window.partitionBy(*keys)
    tagged = df.withColumn("_current", F.max("_year").over(w))
    candidate = (F.col("_year") < F.col("_current")) & ~F.col("_year").isin(*excluded) if excluded else F.col("_year") < F.col("_current")
    tagged = tagged.withColumn("_candidate", candidate)
    rank = F.dense_rank().over(w.orderBy(F.col("_candidate").desc(), F.col("_year").desc()))
    tagged = tagged.withColumn("_rank", rank)
    role = F.when(F.col("_year") == F.col("_current"), "current").when(F.col("_candidate") & (F.col("_rank") <= range_years), "prior")
    return tagged.withColumn("role", role).filter("role is not null").drop("_candidate", "_rank")


def band(
    df: DataFrame, keys: Sequence[str], period: str, value: str, grain: str = "monthly", excluded: Sequence[int] = (), range_years: int = 5
) -> DataFrame:
    """Prior years as a range per slot of the year, this year beside it.

    A slot holds at most ``range_years`` values, so exact percentiles are small.
    """
    df, k = keyed(df.filter(F.col(value).isNotNull()), keys)
    year, slot, slots = _year_slot(period, grain)
    rows = df.select(*k, year.alias("_year"), slot.alias("slot"), F.col(value).alias("_v"))
    rows = prior_years(rows, k, excluded, range_years)
    prior = F.when(F.col("role") == "prior", F.col("_v"))
    agg = rows.groupBy(*k, "slot").agg(
        F.count(prior).alias("n_years"), F.min(prior).alias("minimum"), F.percentile(prior, 0.25).alias("p25"),
        F.percentile(prior, 0.5).alias("median"), F.percentile(prior, 0.75).alias("p75"), F.max(prior).alias("maximum"),
        F.avg(prior).alias("mean"), F.max(F.when(F.col("role") == "current", F.col("_v"))).alias("current"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "prior", F.struct("_year", "_v")))).alias("by_year"),
    )
    years = rows.groupBy(*k).agg(
        F.max("_current").alias("current_year"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "prior", F.col("_year")))).alias("years_used"),
    )
    spine = years.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots))))
    out = spine.join(agg, [*k, "slot"], "left").withColumn("n_years", F.coalesce("n_years", F.lit(0)))
    return unkeyed(keys, out)


def demean_complete_years(df: DataFrame, keys: Sequence[str], period: str, value: str, excluded: Sequence[int] = (), partial: bool = False) -> DataFrame:
    """Values less their own year's mean, for years with all twelve months.

    With ``partial`` the other years stay too, flagged by ``complete``.
    """
    df, k = keyed(df.filter(F.col(value).isNotNull()), keys)
    rows = df.withColumn("year", F.year(period)).withColumn("month", F.month(period))
    if excluded:
        rows = rows.filter(~F.col("year").isin(*excluded))
    w = Window.partitionBy(*k, "year")
    rows = rows.withColumn("complete", F.count("*").over(w) == 12).withColumn("demeaned", F.col(value) - F.avg(value).over(w))
    return unkeyed(keys, rows if partial else rows.filter("complete"))


def shape(df: DataFrame, keys: Sequence[str], period: str, value: str, excluded: Sequence[int] = ()) -> DataFrame:
    """Mean and standard error of the demeaned value per calendar month."""
    rows = demean_complete_years(df, keys, period, value, excluded)
    return rows.groupBy(*keys, "month").agg(
        F.avg("demeaned").alias("mean"), (F.stddev_samp("demeaned") / F.sqrt(F.count("demeaned"))).alias("se"), F.count("*").alias("years")
    )


def seasons(
    df: DataFrame, keys: Sequence[str], period: str, value: str, season: Sequence[tuple[int, int]], excluded: Sequence[int] = ()
) -> DataFrame:
    """One difference per season: its months' mean less the mean of the other months it spans.

    A season that reaches into the next year needs both years complete.
    """
    rows = demean_complete_years(df, keys, period, value, excluded)
    span = max(o for o, _ in season) + 1
    # each month serves the season that starts in its own year and those that started before
    long = rows.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).withColumn("season", F.col("year") - F.col("_offset"))
    inside = F.lit(False)
    for o, m in season:
        inside = inside | ((F.col("_offset") == o) & (F.col("month") == m))
    agg = long.groupBy(*keys, "season").agg(
        F.count("*").alias("_months"),
        F.avg(F.when(inside, F.col("demeaned"))).alias("in_season"),
        F.avg(F.when(~inside, F.col("demeaned"))).alias("out_season"),
    )
    return agg.filter(F.col("_months") == 12 * span).drop("_months").withColumn(
        "difference", F.col("in_season") - F.col("out_season")
    )


def claim(per_season: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Does the season stand out: mean, median, t across seasons, and whether the claim holds."""
    agg = per_season.groupBy(*keys).agg(
        F.count("*").alias("seasons"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        F.avg("in_season").alias("in_season"), F.avg("out_season").alias("out_season"),
        F.avg("difference").alias("difference"), F.percentile("difference", 0.5).alias("median"),
        F.when(F.count("*") > 1, F.stddev_samp("difference") / F.sqrt(F.count("*"))).alias("se"),
        F.count_if(F.col("difference") > 0).alias("positive"),
    )
    t = F.when(F.col("se") > 0, F.col("difference") / F.col("se"))
    return agg.withColumn("t", t).withColumn("holds", F.coalesce(F.col("t") > Z95, F.lit(False)))
