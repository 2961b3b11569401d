"""Similarity join of texts on shingles: prefixes of single tokens and of token combinations.

A token is the hash of a shingle. All texts order their tokens alike: by how many documents hold
them, as a count-min sketch estimates it (one, several, many), then by hash. The sketch has as many
cells as the texts need and lies spread over shards: texts travel in parcels, a parcel asks the
shards for its tokens' cells and gets back two bits for each. A text that occurs several times
counts once. If two sets are
similar, the smallest token they share stands early in both: in the first ``n - o + 1`` of a set of
``n`` that must share ``o``. Tokens held by one document can't be shared; those held by several are
indexed alone. If the smallest token shared is one of many documents, all tokens shared are. Then
the prefix is extended by ``g`` tokens, among which the smallest ``g + 1`` shared ones stand. They
fall into ``g`` slots by hash, so that two of them share a slot, and all pairs of tokens of one
slot are indexed. ``g`` is a quarter of the size of the smaller set, rounded down to a power of
two, so both sides know it up to two values and index both: about as many pairs as tokens.

Of the documents that meet at an index key, each is first compared with the smallest one, the key's
centre. If a key then still holds several classes, every document outside the centre's class is
compared with all that meet at keys of that centre: once, in blocks, however many keys they share.
What comes out of a block are pairs of classes that a link joins, not pairs of documents.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from spreadlake.llm.common import WordHasher, forget, mix, partitions, runs, slices, stored
from spreadlake.llm.graph import components
from spreadlake.llm.sketch import ANSWER, QUESTION, answered, asked, bits_for, counted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle.
SHINGLE = 5

#: Documents from which a token is taken as one of many.
FREQUENT = 100

#: Characters of a parcel of texts, and how many parcels there are at least.
PARCEL_CHARS, PARCELS = 12_000_000, 32

#: Documents on either side of a block of comparisons.
BLOCK = 512

_SLICE = 1 << 20

#: Columns of the index.
INDEX = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "k1", "k2")), *((c, pa.list_(pa.int64())) for c in ("keys", "tokens"))])


def needed(n):
    """Tokens that a set of ``n`` must share with any set similar to it at three quarters."""
    return (3 * n + 3) // 4


def token_sets(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(row, token): the distinct shingles of every text; with fewer words, all of them as one."""
    hashes, counts = hasher.batch(column)
    tokens, n = runs(hashes, counts, SHINGLE, 5)
    row = np.repeat(np.arange(len(counts)), n)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        first = np.cumsum(counts) - counts
        own = []
        for k in few:
            h = np.uint64(counts[k])
            for x in hashes[first[k] : first[k] + counts[k]]:
                h = mix(np.array([h ^ x]) * np.uint64(0x9E3779B97F4A7C15))[0]
            own.append(h)
        row, tokens = np.concatenate([row, few]), np.concatenate([tokens, np.array(own, np.uint64)])
    order = np.lexsort((tokens, row))
    row, tokens = row[order], tokens[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (tokens[1:] != tokens[:-1])
    return row[new], tokens[new]


def _slot_pairs(tokens: np.ndarray, slots: int, band: int) -> np.ndarray:
    """Keys of all pairs of tokens that fall into one slot; ``tokens`` are in the common order."""
    slot = (mix(tokens + np.uint64(77)) % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, tokens = slot[order], tokens[order]
    keys, shift = [], 1
    while True:
        same = slot[shift:] == slot[:-shift] if shift < len(slot) else np.zeros(0, bool)
        if not same.any():
            break
        keys.append(mix(tokens[:-shift][same] * np.uint64(3) + mix(tokens[shift:][same] + np.uint64(band))))
        shift += 1
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def index_keys(row: np.ndarray, tokens: np.ndarray, several: np.ndarray, many: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all index keys of the token sets."""
    level = several.astype(np.int8) + many
    order = np.lexsort((tokens, level, row))
    row, tokens, level = row[order], tokens[order], level[order]
    n = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n) - n
    place = np.arange(len(row)) - first[row]
    prefix = (n - needed(n) + 1)[row]
    alone = (level == 1) & (place < prefix)
    rows, keys = [row[alone]], [tokens[alone]]
    for k in np.unique(row[(level == 2) & (place < prefix)]):
        own = tokens[first[k] : first[k] + n[k]]
        frequent = level[first[k] : first[k] + n[k]] == 2
        reach = n[k] - needed(n[k]) + 1
        for band in {int(needed(n[k])).bit_length() - 1, int(n[k]).bit_length() - 1}:
            slots = max(1, (1 << band) // 4)
            if band == 0:
                continue  # sets of one token are similar only if they are the same
            pairs = _slot_pairs(own[: reach + slots][frequent[: reach + slots]], slots, band)
            rows.append(np.full(len(pairs), k))
            keys.append(pairs)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def copies_of(named: DataFrame) -> DataFrame:
    """(doc_id, _h): rows of ``named`` whose text a document with a smaller id has as well."""
    named = named.filter("doc_id is not null").select("doc_id", "_h")
    firsts = named.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    # stored, so that both sides of the join are shuffled for it and hot keys can be split
    firsts = stored(firsts.filter("_first < _last").drop("_last"), "jaccard-first-texts")
    return stored(named.join(firsts, "_h").filter("doc_id > _first").select("doc_id", "_h").distinct(), "jaccard-copies")


def _parcel_sets(texts: pa.Table, copies: pa.Table):
    """(slice, row, token, own) of a parcel's texts: their sets, and which rows have an id and are no copies."""
    known = {x for x in zip(*(copies[c].to_pylist() for c in ("doc_id", "_h"))) if x[0] is not None}
    hasher = WordHasher(lower=True)
    for part in slices(texts.select(["doc_id", "_text", "_h"]).to_batches(), 1, _SLICE):
        ids, hashes = (part.column(k).to_pylist() for k in (0, 2))
        own = np.array([i is not None and (i, h) not in known for i, h in zip(ids, hashes)], bool)
        yield part, *token_sets(part.column(1), hasher), own


def indexed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, k1, k2, keys, tokens): size, 128-bit hash and index keys of every text's set; the set if it has keys.

    Copies of a text of a smaller id have no keys, nor have rows without an id.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"), F.md5(F.col(text).cast("binary")).alias("_h"))
    named = base.filter("_h is not null").select("doc_id", "_h", F.length("_text").cast("bigint").alias("_chars"))
    named = stored(named, "jaccard-texts")
    chars = int(named.agg(F.coalesce(F.sum("_chars"), F.lit(0))).first()[0])
    bits, n = bits_for(chars / 6 * 2, most=60), max(PARCELS, -(-chars // PARCEL_CHARS))

    def parcel(df: DataFrame) -> DataFrame:
        return df.withColumn("_parcel", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(n)))

    # both uses of the texts and of the copies read one shuffle
    texts, copies = parcel(base), parcel(copies_of(named))

    def ask(key, own: pa.Table, twice: pa.Table) -> pa.Table:
        tokens = [tokens[mask[row]] for _, row, tokens, mask in _parcel_sets(own, twice)]
        return asked(key[0].as_py(), np.concatenate(tokens) if tokens else np.empty(0, np.uint64), bits)

    questions = texts.groupBy("_parcel").cogroup(copies.groupBy("_parcel")).applyInArrow(ask, QUESTION)
    answers = questions.groupBy("shard").applyInArrow(lambda group: counted(group, bits, (2, FREQUENT)), ANSWER)

    def work(own: pa.Table, notes: pa.Table) -> pa.Table:
        sets = list(_parcel_sets(own, notes.filter(pc.is_valid(notes["doc_id"]))))
        kept = [tokens[mask[row]] for _, row, tokens, mask in sets]
        tokens = np.concatenate(kept) if kept else np.empty(0, np.uint64)
        several, many = answered(notes.filter(pc.is_valid(notes["shard"])), tokens, bits, 2)
        ends = np.cumsum([len(x) for x in kept])
        out = []
        for (part, row, tokens, mask), own_tokens, end in zip(sets, kept, ends):
            m, at = part.num_rows, slice(end - len(own_tokens), end)
            n = np.bincount(row, minlength=m)
            key_row, keys = index_keys(row[mask[row]], own_tokens, several[at], many[at], m)
            k1, k2 = (np.zeros(m, np.uint64) for _ in "12")
            np.add.at(k1, row, mix(tokens))
            np.add.at(k2, row, mix(tokens ^ np.uint64(0xABCDEF1234567)))
            ends_ = np.cumsum(np.bincount(key_row, minlength=m))
            with_keys = np.diff(ends_, prepend=0) > 0
            held = np.where(with_keys, n, 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()), pa.array(tokens[with_keys[row]].view(np.int64))
            )
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends_)), pa.int32()), pa.array(keys.view(np.int64))),
                        lists,
                    ],
                    INDEX.names,
                )
            )
        return pa.Table.from_batches(out, INDEX)

    notes = answers.withColumns({"doc_id": F.lit(None).cast("bigint"), "_h": F.lit(None).cast("string")})
    notes = notes.unionByName(copies.select("doc_id", "_h", "_parcel"), allowMissingColumns=True)
    kinds = "doc_id bigint, n bigint, k1 bigint, k2 bigint, keys array<bigint>, tokens array<bigint>"
    return texts.groupBy("_parcel").cogroup(notes.groupBy("_parcel")).applyInArrow(work, kinds)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar: 100 times what they share is at least 75 times what they hold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("_b"))
    joined = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    # with what both hold counted once: 100 s >= 75 (a + b - s)
    return joined.filter(F.lit(175) * shared >= F.lit(75) * (F.size("_a") + F.size("_b"))).select("a", "b")


def joined_classes(met: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of classes with a link between them; ``met`` has _c, doc_id, _class, the centre's own row among them.

    Under each centre, documents outside its class are compared with all. Both sides are cut into
    blocks by a hash of the id, so that a centre of any number of documents is spread over tasks;
    centres of one block share groups.
    """
    own = met.filter("doc_id = _c").select("_c", F.col("_class").alias("_own"))
    met = met.join(own, "_c").withColumn("_stray", F.col("_class") != F.col("_own"))
    sizes = met.groupBy("_c").agg(F.count("*").alias("_all"), F.count_if("_stray").alias("_strays"))
    met = met.join(stored(sizes.filter("_strays > 0"), "jaccard-sizes"), "_c")
    blocks = {side: F.ceil(F.col(n) / block).cast("int") for side, n in (("_i", "_strays"), ("_j", "_all"))}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    every = {side: F.sequence(F.lit(0), n - 1) for side, n in blocks.items()}
    at = {side: (spread % n).cast("int") for side, n in blocks.items()}
    others = met.withColumn("_j", at["_j"]).withColumn("_i", F.explode(every["_i"])).withColumn("_right", F.lit(True))
    others = others.withColumn("_left", F.col("_stray") & (F.col("_i") == at["_i"]))
    # where a document outside stands on both sides of a block it travels once
    strays = met.filter("_stray").withColumn("_i", at["_i"]).withColumn("_j", F.explode(every["_j"])).filter(F.col("_j") != at["_j"])
    sides = strays.withColumns({"_right": F.lit(False), "_left": F.lit(True)}).unionByName(others)
    n = 4 * partitions(met.sparkSession)
    alone = (blocks["_i"] == 1) & (blocks["_j"] == 1)
    group = F.when(alone, F.pmod(F.xxhash64("_c"), F.lit(n))).otherwise(F.xxhash64("_c", "_i", "_j"))
    rows = sides.select("doc_id", "_c", "_class", "_left", "_right", "_i", "_j", group.alias("_group")).join(sets, "doc_id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for _, part in pdf.groupby(["_c", "_i", "_j"]):
            right = part[part["_right"]]
            size = right["tokens"].map(len).to_numpy()
            classes = right["_class"].to_numpy()
            tokens = np.concatenate(right["tokens"].to_list())
            owner = np.repeat(np.arange(len(right)), size)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for x, c in zip(*(part.loc[part["_left"], k] for k in ("tokens", "_class"))):
                lo, hi = (np.searchsorted(tokens, x, side) for side in ("left", "right"))
                many = hi - lo
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                both = np.bincount(owner[at], minlength=len(right))
                for other in set(classes[(175 * both >= 75 * (size + len(x))) & (classes != c)].tolist()):
                    found.add((max(c, other), min(c, other)))
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return rows.groupBy("_group").applyInPandas(compare, "a bigint, b bigint").distinct()


def _sized(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    return pairs.filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of every document under the links of similar sets.

    Documents with the same set are one before the join and get the class of the smallest of them.
    Null texts and texts without words have an empty set and are linked with nothing; a row without
    an id is one of those, too, with no class. Rows that share an id count as linked and come out
    once, with the larger of their sets. An empty table gives an empty result.
    """
    rows = stored(indexed(docs, doc_id, text), "jaccard-index")
    same = rows.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("_first"))
    same = stored(same, "jaccard-same")
    firsts = same.select(F.col("_first").alias("doc_id"), "n", "k1", "k2").distinct()
    # a document that stands for its set brings the keys of that set
    keyed = rows.filter(F.size("keys") > 0).drop("tokens").join(firsts, ["doc_id", "n", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    met = keyed.select("doc_id", "n", F.explode(F.array_distinct("keys")).alias("key"))
    heads = met.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("_head"), F.max("doc_id").alias("_last"))
    heads = heads.filter("_head.doc_id < _last").select("key", F.col("_head.doc_id").alias("_c"), F.col("_head.n").alias("_cn"))
    shared = stored(met.join(heads, "key"), "jaccard-keys")
    wanted = shared.select("doc_id").distinct().join(firsts, "doc_id").select("doc_id", "n", "k1", "k2")
    sets = rows.filter(F.size("tokens") > 0).select("doc_id", "n", "k1", "k2", "tokens").join(wanted, ["doc_id", "n", "k1", "k2"], "left_semi")
    sets = stored(sets.dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "tokens"), "jaccard-sets")
    slim = stored(rows.select("doc_id", "n", "k1", "k2"), "jaccard-rows")
    forget(rows)
    rows = slim

    star = _sized(shared.filter("doc_id <> _c").select(F.col("doc_id").alias("a"), F.col("_c").alias("b"), F.col("n").alias("n_a"), F.col("_cn").alias("n_b")))
    star = stored(star, "jaccard-star")
    links = stored(verified(star, sets), "jaccard-links")
    classes = components(links)

    # keys at which several classes are left
    labelled = shared.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labelled = labelled.select("key", "_c", "doc_id", F.coalesce("component", "doc_id").alias("_class"))
    mixed = labelled.groupBy("key").agg(F.min("_class").alias("_lo"), F.max("_class").alias("_hi")).filter("_lo < _hi").select("key")
    left = labelled.join(stored(mixed, "jaccard-mixed"), "key").select("_c", "doc_id", "_class").distinct()
    left = stored(left, "jaccard-left")
    forget(shared)
    links = links.unionByName(joined_classes(left, sets))

    # documents of one set, and rows of one id, are linked as well
    copies = rows.filter("n > 0 and doc_id is not null").join(same, ["n", "k1", "k2"]).filter("doc_id <> _first")
    every = links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("_first").alias("b")))
    found = components(every).withColumnRenamed("id", "doc_id")
    forget(sets)
    per = rows.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return per.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
