"""Small frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ALL = "_all"


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``keys`` as given, or one constant column when the frame is a single series."""
    if keys:
        return df, list(keys)
    return df.withColumn(ALL, F.lit(0)), [ALL]


def unkeyed(keys: Sequence[str], df: DataFrame) -> DataFrame:
    """Drop the constant column again, but only where ``keyed`` added it for this caller."""
    return df if keys else df.drop(ALL)


def values_frame(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A literal dimension table. Its size is fixed by the text, so it may be broadcast."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def by(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def split_rejects(df: DataFrame, reason: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows with their reason.

    ``reason`` is NULL for a good row. One bad row must not kill a job, so the
    default returns both frames; ``strict`` raises on the first bad row instead.
    """
    tagged = df.withColumn("reason", reason)
    if strict:
        checked = tagged.withColumn(
            "reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")))
        )
        return checked.drop("reason"), tagged.limit(0)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(
        F.col("reason").isNotNull()
    )


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of a row in which a NULL has its place, so that a value moving across it shows."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])
