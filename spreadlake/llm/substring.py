"""Removing passages that an earlier document holds already.

Two count-min sketches say which windows of ``WINDOW`` words may be repeated. The first counts in how
many documents each anchor stands, the smallest hash among the short runs of a window, which
neighbouring windows share, so that it has few keys. The second counts the windows themselves that
pass the first. Both may count too many but never too few, so a window that starts in two
documents always passes.

Only windows that pass are shuffled, with a 96-bit hash of all their words. What the sketch counts
fewer than ``MANY`` times has groups below that size, whose smallest document a window function
finds. The others, whose groups have no bound, are grouped by a plain aggregate, which combines in
the tasks before anything moves, and joined to what it found, where adaptive execution can split
hot keys.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from spreadlake.llm.common import WordHasher, mix, powers, runs, slices, stored, total_chars
from spreadlake.llm.sketch import Reached, bits_for, count_min

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a window, and of the short runs that anchor it.
WINDOW, SHORT = 50, 5

#: Rows of the anchors' sketch, and the power of two its cells stop at: 2 x 64 MB of bits.
DEPTH, MOST_BITS = 2, 29

#: The power of two at which the cells of the windows' sketch stop: one row x 2 thresholds x 32 MB of bits.
WINDOW_BITS = 28

#: Windows counted so often may have a group too large for one task.
MANY = 64

_SLICE = 1 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by running minima inside blocks from both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def windows(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word among all words, row, anchor) of every window."""
    n = np.maximum(counts - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    if not len(row):
        return row, row, np.empty(0, np.uint64)
    first = np.cumsum(counts) - counts
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # short runs over all words; those across two texts lie in no window
    short, _ = runs(hashes, np.array([len(hashes)]), SHORT, 21)
    return at, row, sliding_min(short, window - SHORT + 1)[at]


def _window_hashes(hashes: np.ndarray, at: np.ndarray, window: int, salt: int) -> np.ndarray:
    odd = int(np.random.default_rng(salt).integers(0, 1 << 61, dtype=np.uint64)) * 8 + 3
    up, down = powers(odd, len(hashes)), powers(pow(odd, -1, 1 << 64), len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)) * up)))
    return mix((sums[at + window] - sums[at]) * down[at])


def repeated_windows(docs: DataFrame, doc_id: str, text: str, row: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, at): first words of the windows that also start in a document with a smaller id."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(row).alias("_row"), F.col(text).alias("_text"))
    base = base.filter(F.col("_text").isNotNull() & F.col("doc_id").isNotNull())
    # about two anchors in a window's length of words, four cells to each
    bits = bits_for(total_chars(base, "_text") / 6 * 2 / (window - SHORT + 2) * 4, most=MOST_BITS)

    def anchors_of(batch):
        for part in slices(iter([batch]), 2, _SLICE):
            _, of, anchor = windows(*WordHasher().batch(part.column(2)), window)
            new = np.ones(len(of), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
            of, anchor = of[new], anchor[new]
            # once per document
            _, once = np.unique(mix(anchor + mix(of.astype(np.uint64))), return_index=True)
            yield anchor[once]

    spark = base.sparkSession
    (often,) = count_min(base, anchors_of, bits, DEPTH, (2,))
    anchors = spark.sparkContext.broadcast(often)

    def passing(part, hasher, reached):
        hashes, counts = hasher.batch(part.column(2))
        at, of, anchor = windows(hashes, counts, window)
        keep = reached(anchor)
        at, of = at[keep], of[keep]
        return at - (np.cumsum(counts) - counts)[of], of, *(_window_hashes(hashes, at, window, salt) for salt in (31, 32))

    def windows_of(batch):
        hasher, reached = WordHasher(), Reached(anchors.value, bits)
        for part in slices(iter([batch]), 2, _SLICE):
            yield passing(part, hasher, reached)[2]

    window_bits = bits_for(total_chars(base, "_text") / 6, most=WINDOW_BITS)
    counted = spark.sparkContext.broadcast(count_min(base, windows_of, window_bits, 1, (2, MANY)))

    def rows_of(many: bool):
        def work(batches):
            reached, hasher = Reached(anchors.value, bits), WordHasher()
            several, large = (Reached(x, window_bits) for x in counted.value)
            for part in slices(batches, 2, _SLICE):
                at, of, h1, h2 = passing(part, hasher, reached)
                keep = several(h1)
                keep[keep] = large(h1[keep]) == many
                at, of, h1, h2 = at[keep], of[keep], h1[keep], h2[keep]
                ids, rows = (part.column(i).to_numpy(zero_copy_only=False)[of] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(33)).astype(np.int32)),
                        pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()),
                    ],
                    ["h1", "h2", "doc_id", "_row", "at"],
                )

        return base.mapInArrow(work, "h1 bigint, h2 int, doc_id bigint, _row bigint, at int")

    few = rows_of(False).withColumn("_first", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
    large = rows_of(True)
    firsts = large.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    # stored, so that both sides of the join are shuffled for it and hot keys can be split
    firsts = stored(firsts.filter("_first < _last").drop("_last"), "substring-firsts")
    large = large.join(firsts, ["h1", "h2"])
    both = few.unionByName(large.select(*few.columns))
    return both.filter("_first < doc_id").select("doc_id", "_row", "at")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, ``keep``): every text without the words of repeated windows.

    ``kept`` are the words left, joined by one space. Windows are judged on the input. Null and
    empty texts have no words. Rows that share an id are one document: none is earlier than the
    other, so they keep what no smaller id holds. Rows without an id are kept whole and make no
    other one's words go. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep if c != text])
    rows = rows.withColumn("_row", F.xxhash64("doc_id", "_text"))
    found = repeated_windows(rows, "doc_id", "_text", "_row", window)
    cuts = found.groupBy("doc_id", "_row").agg(F.collect_set("at").alias("_at"))
    joined = rows.join(cuts, ["doc_id", "_row"], "left")
    others = [c for c in keep if c != text]
    # the text travels once, also where it is kept
    place = {c: 3 + i for i, c in enumerate(others)} | {text: 1}

    def cut(batches):
        for part in slices(batches, 1):
            n_words, n_removed, left = [], [], []
            for t, at in zip(part.column(1).to_pylist(), part.column(2)):
                words = (t or "").encode().split()
                n_words.append(len(words))
                if at.is_valid and len(at):
                    edge = np.zeros(len(words) + 1, np.int64)
                    start = at.values.to_numpy()
                    edge[start] += 1
                    np.add.at(edge, start + window, -1)
                    keep_ = np.cumsum(edge)[:-1] == 0
                    words = [w for w, k in zip(words, keep_) if k]
                n_removed.append(n_words[-1] - len(words))
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words), pa.array(n_removed), pa.array(left, pa.string()), *(part.column(place[c]) for c in keep)],
                ["doc_id", "n_words", "n_removed", "kept", *keep],
            )

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.select("doc_id", "_text", "_at", *[f"_keep_{c}" for c in others]).mapInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string" + kinds
    )
