"""Places of rows in an order, without a window over a whole group.

Rows are sorted by ranges, so that a group of any size is spread over tasks, and stored with a number
that rises along the order. How many rows of a group lie in each range, one small row per group and
range, then gives every row its place in its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.llm.common import partitions, stored

#: Bits of a row's number that count inside its range.
_INSIDE = 33


def key_of(column: str | Column) -> Column:
    """A key that is never null and sorts null first, text by its bytes."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def in_order(df: DataFrame, order: list[Column], label: str, change=lambda x: x) -> DataFrame:
    """``df`` sorted by ranges of ``order``, changed by ``change`` (which keeps the order), with its number ``_at``; stored.

    Rows that are alike in all of ``order`` are told apart by where they were read, so that a group of
    copies is spread, too.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranges = salted.repartitionByRange(partitions(df.sparkSession), *order, F.col("_salt"))
    placed = change(ranges.sortWithinPartitions(*order, F.col("_salt")).drop("_salt"))
    return stored(placed.withColumn("_at", F.monotonically_increasing_id()), label)


def within(df: DataFrame, key: str = "_key") -> DataFrame:
    """``df`` of ``in_order`` with each row's place in its group, ``_index`` from 0, and the group's rows, ``_n``."""
    cut = F.shiftright("_at", _INSIDE)
    per = df.groupBy(key, cut.alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(key)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(
        key, "_range", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"), F.sum("_rows").over(group).alias("_n")
    )
    joined = df.withColumn("_range", cut).join(bases, [key, "_range"])
    return joined.withColumn("_index", F.col("_base") + F.col("_at") - F.col("_first")).drop("_range", "_first", "_base")
