"""Document fingerprints from closed syncmers.

A text is read as words. A k-mer is ``K`` consecutive words, its inner substrings are the runs of
``S`` words in it. A k-mer is an anchor if the smallest hash of its inner substrings is the first
or the last of them. Whether a k-mer is chosen depends on its own words alone, so an edit moves no
anchor outside it, and no run of ``K - S + 1`` k-mers is without an anchor. The fingerprint is the
anchors in text order, so that two texts can be matched by where their anchors stand. All of it is
array functions inside the row: no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.llm.common import partitions, stored

#: Words of a k-mer and of its inner substrings.
K, S = 5, 2

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def words_of(text: str) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _fold(a: Column, n: Column, shifts: list[int], f) -> Column:
    """``f`` folded over ``a[i + shift]`` for the shifts given, for i from 0 to below ``n``."""
    out = F.slice(a, F.lit(1 + shifts[0]), n)
    for shift in shifts[1:]:
        out = F.zip_with(out, F.slice(a, F.lit(1 + shift), n), f)
    return out


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with ``out``: the hashes of the anchors of ``text`` in text order.

    Both ends are padded with ``k - 1`` marks, so that a text of any word has k-mers; a text without
    words has none. Each step is a column of its own, because an array that a lambda
    reaches for from outside would be made again for every element.
    """
    h, g, e, m, a = (f"_{out}_{x}" for x in "hgema")
    inner = k - s + 1
    df = df.withColumn(h, F.transform(words_of(text), lambda x: F.xxhash64(x)))
    ends = [F.array_repeat(F.lit(mark).cast("bigint"), k - 1) for mark in (1, 2)]
    df = df.withColumn(h, F.when(F.size(h) == 0, F.col(h)).otherwise(F.concat(ends[0], F.col(h), ends[1])))
    smers = F.greatest(F.size(h) - (s - 1), F.lit(0))
    df = df.withColumn(g, _fold(F.col(h), smers, list(range(s)), lambda x, y: F.xxhash64(x, y)))
    kmers = F.greatest(F.size(g) - (inner - 1), F.lit(0))
    df = df.withColumn(e, _fold(F.col(g), kmers, [0, inner - 1], lambda x, y: F.least(x, y)))
    df = df.withColumn(m, _fold(F.col(g), kmers, list(range(1, inner - 1)), lambda x, y: F.least(x, y)))
    # inner substrings that cover the k-mer stand for it
    cover = sorted({*range(0, inner, s), inner - 1})
    df = df.withColumn(a, _fold(F.col(g), kmers, cover, lambda x, y: F.xxhash64(x, y)))
    edge = F.zip_with(F.col(e), F.col(m), lambda x, y: x <= y)
    chosen = F.array_compact(F.zip_with(edge, F.col(a), lambda keep, x: F.when(keep, F.hash(x))))
    return df.withColumn(out, chosen).drop(h, g, e, m, a)


def as_text(anchors: Column) -> Column:
    """The anchors as eight hexadecimal digits each, in text order."""
    return F.array_join(F.transform(anchors, lambda x: F.right(F.concat(F.lit("0000000"), F.hex(x)), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct anchors; two texts without words are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def next_ids(ids: DataFrame, doc_id: str) -> DataFrame:
    """Each of the distinct ids with the next larger one in ``_next``; after the largest comes the smallest.

    Ids are cut into ranges at quantiles, one per shuffle partition. Inside a range the next id is a
    window function, and only one row per range crosses from one range to the next.
    """
    n = partitions(ids.sparkSession)
    cuts = ids.agg(F.percentile_approx(doc_id, [i / n for i in range(1, n)] or [0.5], 1000)).first()[0] or []
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    ranged = ids.withColumn("_range", F.size(F.filter(cut, lambda c: c <= F.col(doc_id))))
    inside = ranged.withColumn("_next", F.lead(doc_id).over(Window.partitionBy("_range").orderBy(doc_id)))
    edges = ranged.groupBy("_range").agg(F.min(doc_id).alias("_first"))
    after = F.coalesce(F.lead("_first").over(Window.orderBy("_range")), F.min("_first").over(Window.partitionBy()))
    edges = edges.select("_range", after.alias("_after"))
    return inside.join(edges, "_range").select(doc_id, F.coalesce("_next", "_after").alias("_next"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next one's are.

    The edited text has its last quarter of characters replaced by as many from the head of the
    next document by id. A document asks its next one for that head and its anchors; texts are
    shuffled once, by id.

    Null texts are empty; rows without an id are left out, as they have no place in the order of
    ids. A repeated id gives a row for each of its rows, all against the same next document (of
    several that share an id, the smallest text). One document is its own next. An empty table
    gives an empty result. Other columns are not carried.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.filter("doc_id is not null")
    ids = stored(base.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.length("text")).alias("longest")), "fingerprint-ids")
    repeated = ids.filter("rows > 1").limit(1).count() > 0
    follow = next_ids(ids.select("doc_id"), "doc_id").join(ids, "doc_id")
    asks = follow.select(F.col("doc_id").alias("_asker"), F.col("_next").alias("doc_id"), F.expr("int(longest div 4)").alias("_most"))
    nexts = base.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else base
    nexts = nexts.join(asks, "doc_id").select("_asker", "text", F.substring("text", F.lit(1), F.col("_most")).alias("_head"))
    heads = with_anchors(nexts, "text", "_next_anchors").select(
        F.col("_asker").alias("doc_id"), "_head", F.array_distinct("_next_anchors").alias("_next_anchors")
    )
    both = base.join(heads, "doc_id").withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.expr("int(n_chars div 4)")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    both = both.withColumn("_edited", F.concat(kept, F.substring(F.col("_head"), F.lit(1), quarter)))
    both = with_anchors(both, "text", "_own")
    both = with_anchors(both, "_edited", "_of_edited")
    own = F.array_distinct("_own")
    both = both.withColumn("_set", own)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("_edited", "utf-8"), 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_of_edited")).alias("edited_fingerprint"),
        likeness(F.col("_set"), F.array_distinct("_of_edited")).alias("near_edited"),
        likeness(F.col("_set"), F.col("_next_anchors")).alias("near_next"),
    )
