"""Mixing sources to target weights.

Words are summed per source before anything is shuffled by source. A source's target is its share
of the wanted total by weight, at most ``max_rate`` times its size; what it can't take is shared
again by weight among the others. With sources in the order of size per weight, those that are
full come first, so one running sum over the sources finds the level ``t`` at which
``sum(min(t * weight, max_rate * size))`` is the wanted total. A document is emitted
``floor(rate)`` times, and once more if a hash of its id and the seed falls below the fraction.
Of ``TURNS`` seeds, which turn the hash by equal steps, each source takes the one whose words come
nearest to its target: a small source is else far off by chance alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.llm.common import stored

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"

#: Seeds that a source chooses from.
TURNS = 32

#: The dimension of sources is broadcast up to so many rows; beyond, the join is left to the optimizer.
BROADCAST_SOURCES = 50_000


def size_of(text: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, max_rate: float
) -> DataFrame:
    """One row per source: its size, weight and target.

    Sources are ranked by code point, null last, and take ``weights`` in turn. The windows run over
    one row per source, not over documents. A source without words has target 0.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = per.withColumn("weight", weight)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col(source).asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everything).cast("double") * F.lit(float(share))).alias("_wanted"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double").alias("_full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
    )
    level = (F.col("_wanted") - F.lit(float(max_rate)) * F.col("_full")) / F.col("_open")
    own = F.lit(float(max_rate)) * F.col("source_size").cast("double")
    # the first source whose cap lies above its level sets the level of all that follow
    ranked = ranked.withColumn("_level", F.when(level * F.col("weight") <= own, level))
    ranked = ranked.withColumn("_level", F.first("_level", True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_level").isNull(), own).otherwise(F.least(F.col("_level") * F.col("weight"), own))
    return ranked.select(source, "source_size", "weight", target.alias("target"))


def uniform_of(doc_id: str, text: str, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the id and the seed alone; without an id on the text and the seed."""
    named = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(named, F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_rate: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` appended.

    Null and empty texts have size 0 and take nothing from a target; their copies follow the same
    rate. A null source is a source of its own. Rows that repeat an id are mixed alike; rows without
    an id are drawn by their text. An empty table gives an empty result. Input columns of the names
    appended are replaced, all others are kept whatever their names.
    """
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    named = (doc_id, text, source)
    others = [c for c in docs.columns if c not in (*named, *made)]
    # what is only carried travels in a box, so that no name can clash with those used here
    base = docs.select(*named, F.struct(F.lit(0).alias("_"), *others).alias("_box"))
    sizes = stored(base.select(doc_id, source, size_of(text).alias("size"), uniform_of(doc_id, text, seed).alias("draw")), "mix-sizes")
    dim = source_targets(sizes, source, "size", weights, share, max_rate)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dim = stored(dim.withColumnRenamed(source, "_source").withColumn("rate", rate), "mix-targets")
    small = dim.count() <= BROADCAST_SOURCES
    turns = stored(best_turns(at_source(sizes, dim, source, small)), "mix-turns")
    dim = dim.join(turns, dim["_source"].eqNullSafe(turns["_turned"])).drop("_turned")
    joined = base.withColumn("size", size_of(text)).withColumn("draw", uniform_of(doc_id, text, seed))
    joined = at_source(joined, dim, source, small)
    copies = (F.floor("rate") + (turned(F.col("turn")) < fraction()).cast("long")).cast("long")
    joined = joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    kept = [F.col(c) if c in named else F.col("_box")[c].alias(c) for c in docs.columns if c in named or c in others]
    return joined.select(*kept, *made)


def at_source(df: DataFrame, dim: DataFrame, source: str, small: bool) -> DataFrame:
    """Each row with its source's row; a source that holds many rows is not shuffled if the dimension is small."""
    return df.join(F.broadcast(dim) if small else dim, F.col(source).eqNullSafe(F.col("_source")))


def fraction() -> Column:
    return F.col("rate") - F.floor("rate")


def turned(turn: Column) -> Column:
    """The draw after ``turn`` of ``TURNS`` equal steps around the circle from 0 to 1."""
    u = F.col("draw") + turn / F.lit(float(TURNS))
    return u - F.floor(u)


def best_turns(sized: DataFrame) -> DataFrame:
    """(_turned, turn): the turn of each source whose extra copies come nearest to what its target leaves."""
    sums = [F.sum(F.when(turned(F.lit(t)) < fraction(), F.col("size")).otherwise(0)) for t in range(TURNS)]
    left = F.max("target") - F.floor(F.max("rate")) * F.max("source_size")
    per = sized.groupBy(F.col("_source").alias("_turned")).agg(F.array(*sums).alias("_sums"), left.alias("_left"))
    off = F.transform("_sums", lambda s: F.abs(s.cast("double") - F.col("_left")))
    return per.select("_turned", off.alias("_off")).select(
        "_turned", (F.array_position("_off", F.array_min("_off")) - 1).cast("int").alias("turn")
    )


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as often as ``copies`` says."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
