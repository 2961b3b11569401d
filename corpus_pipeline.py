"""From raw documents to packed training sequences: five stages, each on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, whatever they are. ``run`` writes each result to the shared folder and reads it back, and
deletes the one before, which nothing reads any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spreadlake.llm import jaccard, mixing, packing, quality, substring
from spreadlake.llm.common import crc_mod, forget, stored, table


def _boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, and all but the text in a box beside them, so that no name can clash."""
    return docs.select(*columns, F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def _unboxed(columns: list[str], new: dict | None = None) -> list:
    new = {"text": F.col("text")} | (new or {})
    return [new.get(c, F.col("_row")[c]).alias(c) for c in columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Learned as in the operator's query. A null or empty text is judged by its features like any
    other. Without labels nothing is rejected.
    """
    weights = quality.learn(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return quality.score(_boxed(docs, "doc_id", "text"), weights, keep=("_row", "text")).filter("predicted = 1").select(*_unboxed(docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Documents without words belong to no group and stay, as do rows without an id. Of rows that
    share an id and a text the one with the least other columns stays; different texts of one id stay.
    """
    found = jaccard.near_duplicates(docs)
    first = found.filter("doc_id = component_id").select("doc_id")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count()
    known = docs.join(first, "doc_id", "left_semi")
    if repeated:
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        known = known.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_row"))
        known = known.select(*[c if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])
    return known.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier one holds.

    A text that loses nothing stays as it is; one that loses words keeps the others, joined by one
    space, and ``n_chars`` follows.
    """
    cut = substring.remove_repeats(_boxed(docs, "doc_id", "text"), keep=("_row", "text"))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(F.col("_row.n_chars"))
    return cut.select(*_unboxed(docs.columns, new))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = mixing.mix_sources(_boxed(docs, "doc_id", "text", "source"))
    return mixing.emit_copies(mixed, ["_row", "text"]).select(*_unboxed(docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place there."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't fit a classifier or merge tokens; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
