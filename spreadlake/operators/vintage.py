"""Revisions and vintages: whole-row winners, final over provisional, stitching.

Every winner is a ``max_by`` / ``min_by`` of a struct, which merges on the map
side. History stays in rows; it is never packed into one growing value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.frames import by, keyed, unkeyed
from spreadlake.operators import calendar_ops


def _names(df: DataFrame, keys: Sequence[str], doc: str) -> DataFrame:
    """Distinct contributor ids per key. The list is as long as the document index, not the rows."""
    once = df.groupBy(*keys, doc).agg(F.count("*").alias("_x"))
    return once.groupBy(*keys).agg(
        F.count("*").alias("n_documents"),
        F.array_join(F.transform(F.array_sort(F.collect_list(doc)), lambda x: x.cast("string")), ";").alias("documents"),
    )


def latest_document_wins(
    df: DataFrame, keys: Sequence[str], period: str, grain: str, doc: str, values: Sequence[str]
) -> DataFrame:
    """Per period every value of the newest contributor, whole row, plus who contributed.

    ``df`` holds one row per (keys, period, document). A value the newest
    document did not print stays missing; older ones do not fill it.
    """
    df, k = keyed(df, keys)
    won = df.groupBy(*k, period).agg(
        F.max_by(F.struct(*values), doc).alias("_row"), F.max(doc).alias("source_document")
    ).select(*k, period, "source_document", *[F.col(f"_row.{v}").alias(v) for v in values])
    out = won.join(_names(df, [*k, period], doc), [*k, period])
    return unkeyed(keys, 
        calendar_ops.densify(
            out, k, period, grain, values=[*values, "source_document", "documents"], zeros=["n_documents"]
        )
    )


def final_beats_provisional(
    df: DataFrame,
    keys: Sequence[str],
    vintage: str,
    doc: str,
    provisional: str,
    values: Sequence[str],
    dollar_values: Sequence[str] | None = None,
) -> DataFrame:
    """The newest final print, else the newest print, with its revision facts."""
    dollar = list(values if dollar_values is None else dollar_values)
    rank = F.struct((~F.col(provisional)).alias("f"), F.col(vintage).alias("v"), F.col(doc).alias("d"))
    age = F.struct(F.col(vintage).alias("v"), F.col(doc).alias("d"))
    body = F.struct(*values, F.col(provisional).alias("_p"), F.col(vintage).alias("_v"))
    agg = df.groupBy(*keys).agg(
        F.max_by(body, rank).alias("kept"),
        F.min_by(body, age).alias("first"),
        F.count("*").alias("n_prints"),
    )
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"kept.{v}").eqNullSafe(F.col(f"first.{v}"))
    many = F.col("n_prints") > 1
    moves = [F.abs(F.col(f"kept.{v}") - F.col(f"first.{v}")) for v in dollar]
    largest = F.greatest(*moves) if len(moves) > 1 else moves[0]
    out = agg.select(
        *keys,
        *[F.col(f"kept.{v}").alias(v) for v in values],
        F.col("kept._p").alias("provisional"),
        F.col("kept._v").alias("vintage"),
        F.col("first._v").alias("first_vintage"),
        "n_prints",
        (many & ~same).alias("revised"),
        F.when(many, largest).alias("max_revision"),
    )
    return out.join(_names(df, keys, doc), list(keys))


def format_print(vintage: Column, provisional: Column, values: Mapping[str, Column]) -> Column:
    """One print as ``vintage|status|col=value``; a missing value is left out."""
    parts = [F.date_format(vintage, "yyyy-MM-dd"), F.when(provisional, "provisional").otherwise("final")]
    parts += [F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in values.items()]
    return F.concat_ws("|", *parts)


def parse_print(entry: str) -> Column:
    """The struct behind one print text."""
    parts = F.split(F.col(entry), r"\|")
    pairs = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    body = F.transform_values(
        F.str_to_map(F.array_join(pairs, "|"), F.lit(r"\|"), F.lit("=")), lambda _, v: v.try_cast("double")
    )
    return F.struct(parts[0].try_cast("date").alias("vintage"), parts[1].alias("status"), body.alias("values"))


def first_print(df: DataFrame, keys: Sequence[str], doc: str, value: str) -> DataFrame:
    """The first document's print kept; disagreement is undefined over one print."""
    return df.groupBy(*keys).agg(
        F.min_by(value, doc).alias(value),
        F.count(value).alias("n_prints"),
        F.when(F.count(value) > 1, F.max(value) - F.min(value)).alias("disagreement"),
    )


def stitch(
    df: DataFrame, keys: Sequence[str], period: str, grain: str, doc: str, geometry: str, value: str
) -> DataFrame:
    """Many overlapping short series to one: median, spread, sources, evidence, full spine.

    One reading per document and period goes in, so a group is as long as the
    document index.
    """
    df, k = keyed(df, keys)
    one = df.groupBy(*k, period, doc, geometry).agg(F.avg(value).alias("_v"))
    agg = one.groupBy(*k, period).agg(
        F.median("_v").alias("value"),
        F.when(F.count("_v") > 1, F.max("_v") - F.min("_v")).alias("spread"),
        F.countDistinct(doc).alias("n_notes"),
        F.countDistinct(geometry).alias("n_geometries"),
    )
    dense = calendar_ops.densify(agg, k, period, grain, values=["value", "spread"], zeros=["n_notes", "n_geometries"])
    bounds = calendar_ops.corroboration_bounds(dense, k, period, "n_geometries")
    out = dense.join(bounds, k, "left")
    evidence = calendar_ops.evidence_class(
        F.col(period), F.col("n_notes"), F.col("n_geometries"), F.col("first_corroborated"), F.col("last_corroborated")
    )
    return unkeyed(keys, 
        out.withColumn("cross_checked", F.col("n_geometries") > 1)
        .withColumn("evidence_class", evidence)
        .drop("first_corroborated", "last_corroborated")
    )


def to_slots(df: DataFrame, keys: Sequence[str], doc: str, value: str, slots: int) -> DataFrame:
    """Long readings to wide slots r1..rN in document order; readings beyond the Nth wait, in order, in ``more``."""
    numbered = df.withColumn("_slot", F.row_number().over(by(keys, doc)))
    wide = []
    for i in range(1, slots + 1):
        wide.append(F.max(F.when(F.col("_slot") == i, F.col(doc))).alias(f"r{i}_doc"))
        wide.append(F.max(F.when(F.col("_slot") == i, F.col(value))).alias(f"r{i}_value"))
    late = F.struct("_slot", F.col(doc).alias("doc"), F.col(value).alias("value"))
    more = F.array_sort(F.collect_list(F.when(F.col("_slot") > slots, late)))
    more = F.transform(more, lambda x: F.struct(x["doc"].alias("doc"), x["value"].alias("value")))
    return numbered.groupBy(*keys).agg(F.count("*").alias("n_readings"), *wide, more.alias("more"))


def from_slots(df: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """Wide slots and what waits behind them back to long; an empty slot is no reading."""
    items = F.array(
        *[F.struct(F.lit(i).alias("slot"), F.col(f"r{i}_doc").alias("doc"), F.col(f"r{i}_value").alias("value")) for i in range(1, slots + 1)]
    )
    rest = F.transform("more", lambda x, i: F.struct((i + slots + 1).alias("slot"), x["doc"].alias("doc"), x["value"].alias("value")))
    items = F.concat(items, rest)
    return df.select(*keys, F.inline(items)).filter(F.col("doc").isNotNull())


def agreement(new: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """New readings with no stored one, or further from it than the tolerance."""
    j = new.select(*keys, F.col(value).alias("new_value")).join(
        stored.select(*keys, F.col(value).alias("stored_value")), list(keys), "left"
    )
    problem = F.when(F.col("stored_value").isNull(), "missing").when(
        F.abs(F.col("new_value") - F.col("stored_value")) > tolerance, "differs"
    )
    return j.withColumn("problem", problem).filter("problem is not null")


def merge_stored(stored: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """Stored documents stay; only documents not stored are added."""
    return stored.unionByName(new.join(stored.select(doc).distinct(), doc, "left_anti"))


def substitute_disputed(df: DataFrame, headline: str, alternative: str) -> DataFrame:
    """Months where the alternative exceeds the headline, and the substituted series."""
    disputed = F.coalesce(F.col(alternative) > F.col(headline), F.lit(False))
    return df.withColumn("disputed", disputed).withColumn(
        "substituted", F.when(F.col("disputed"), F.col(alternative)).otherwise(F.col(headline))
    )


def provisional_month(period: str, as_of: str) -> Column:
    return cal.provisional_by_calendar(period, F.lit(as_of).cast("date"))
