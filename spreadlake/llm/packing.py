"""Packing token sequences: bin completion over the histogram of piece lengths.

Two pieces of one length are interchangeable, so which lengths share a sequence is decided on the
number of pieces per length: at most ``capacity`` numbers, however many documents there are. The
largest length left is completed by an undominated filling of the room beside it, and the pattern
is repeated as often as its lengths last. A branch is given up once the waste it has collected
leaves no better packing than the best known one, which starts as the best-fit one. The search runs
over all pieces and, if that leaves a gap to the bound, over those in best-fit sequences that are
not full, whose number of lengths stays small; its branches grow with the distinct lengths, as one
way down takes about as many.

The pieces then find their place by their rank among the pieces of their length. Ranks come from
counts per (length, chunk of ids) and row numbers inside a chunk, so that a length which a third
of all pieces share is not ranked in one task.
"""

from __future__ import annotations

import json
import sys
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from spreadlake.llm.common import partitions, slices, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps of the search before it settles for the best packing found: so many, and per squared number of distinct
#: lengths. A branch takes a step per length left and per filling read, and a way down takes about a branch per length.
STEPS, PER_LENGTH = 100_000, 1

#: Fillings kept per largest length, and read from the table to find them.
FILLINGS, READ = 4, 8

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space of the splitting pattern, for a regular expression that runs over whole columns.
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Segments:
    """Token ids of texts by a byte-level BPE file.

    The pattern that splits a text before merging never goes on over a space that stands alone
    between two other characters. So texts are cut before such spaces, each distinct segment of a
    batch is merged once, and the ids are gathered by the segments' codes. Texts with a space beside
    other white space are merged whole, and those that spell a special token go to the file's own
    tokenizer, which knows it.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.merge = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line = self.merge("\n")[0]

    def by_file(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def distinct(self, parts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each part has): parts without white space are merged in one text of lines."""
        blank = pc.match_substring_regex(parts, _BLANK).to_numpy(zero_copy_only=False)
        plain = ~(blank | (pc.binary_length(parts).to_numpy(zero_copy_only=False) == 0))
        size = np.zeros(len(parts), np.int32)
        words = parts.filter(pa.array(plain)).to_pylist()
        lines = np.array(self.merge(lead + f"\n{lead}".join(words)) if words else [], np.uint32)
        if words:
            size[plain] = np.diff(np.flatnonzero(lines == self.line), prepend=-1, append=len(lines)) - 1
        other = [self.merge(lead + w) for w in parts.filter(pa.array(~plain)).to_pylist()]
        size[~plain] = [len(x) for x in other]
        ids = np.empty(int(size.sum()), np.uint32)
        of_plain = np.repeat(plain, size)
        ids[of_plain] = lines[lines != self.line]
        ids[~of_plain] = np.array([i for x in other for i in x], np.uint32)
        return ids, size

    def batch(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers."""
        text = column.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(text), bool)
        for token in self.special:
            special |= pc.match_substring(text, token).to_numpy(zero_copy_only=False)
        whole = special | pc.match_substring_regex(text, f"{_BLANK} | {_BLANK}").to_numpy(zero_copy_only=False)
        out: list = [None] * len(text)
        for k in np.flatnonzero(whole):
            t = text[int(k)].as_py()
            out[k] = np.array(self.by_file(t) if special[k] else self.merge(t), np.uint32)
        some = np.flatnonzero(~whole)
        if not len(some):
            return out
        parts = pc.split_pattern(text.take(pa.array(some)), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at, flat = at - at[0], parts.flatten()
        head = np.zeros(len(flat), bool)
        head[at[:-1]] = True
        code, ids, sizes, seen = np.empty(len(flat), np.int32), [], [], 0
        for lead, mask in (("", head), (" ", ~head)):
            coded = flat.filter(pa.array(mask)).dictionary_encode()
            own, size = self.distinct(coded.dictionary, lead)
            code[mask] = coded.indices.to_numpy() + np.int32(seen)
            seen += len(size)
            ids.append(own)
            sizes.append(size)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        start = np.cumsum(sizes, dtype=np.int32) - sizes
        size = sizes[code]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        shift = np.repeat(start[code] - ends[:-1].astype(np.int32), size)
        shift += np.arange(len(shift), dtype=np.int32)
        every = ids[shift]
        for k, a, b in zip(some, ends[at[:-1]], ends[at[1:]]):
            out[k] = every[a:b]
        return out


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all are full, but for the first."""
    at, size = 0, (n - 1) % capacity + 1
    while at < n:
        yield at, size
        at, size = at + size, capacity


def pieces_of(docs: DataFrame, doc_id: str, text: str, tokenizer: str, pattern: str, capacity: int, end: int) -> DataFrame:
    """One row per piece of every document, ``end`` closing each document."""

    def work(batches):
        known = Segments(tokenizer, pattern)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for part in slices(batches, 1):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(part.column(0).to_pylist(), known.batch(part.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(rows, (doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(work, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths of a sequence, how many such sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_ if r >= size and open_[r]):
            while left and open_[room]:
                pattern, n = open_[room].pop()
                each = min(room // size, left)
                use = min(n, left // each)
                open_[room - each * size].append((pattern + (size,) * each, use))
                left -= use * each
                if use < n:
                    open_[room].append((pattern, n - use))
            if not left:
                break
        each = capacity // size
        if left >= each:
            open_[capacity - each * size].append(((size,) * each, left // each))
        if left % each:
            open_[capacity - left % each * size].append(((size,) * (left % each), 1))
    return [p for group in open_.values() for p in group]


def reachable(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each number of leading sizes the sums within ``room`` that they reach, as the bits of a number."""
    mask, out = (1 << room + 1) - 1, [1]
    for s in sizes:
        reach, left, step = out[-1], min(counts[s], room // s), 1
        while left:
            use = min(step, left)
            reach |= reach << s * use & mask
            left, step = left - use, step * 2
        out.append(reach)
    return out


def fillings(sizes: list[int], counts: dict[int, int], room: int, slack: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` that waste at most ``slack``, least waste first.

    ``sizes`` ascend. A table says which sums the first so many sizes reach, so a filling is read off
    it without a search: from the largest size down, each as often as it goes. Fillings of one sum
    differ in their largest item. A filling beside which a size left fits, or whose items one of
    another's items could hold, is dominated; of one sum, those with larger items come first.
    """
    reach = reachable(sizes, counts, room)
    out: list[tuple[int, ...]] = []
    read = 0
    for total in range(room, max(room - slack, 0) - 1, -1):
        if not reach[-1] >> total & 1:
            continue
        for top in range(len(sizes), -1, -1):
            if not reach[top] >> total & 1:
                break
            if top and total < sizes[top - 1] or top and not reach[top - 1] >> total - sizes[top - 1] & 1 and counts[sizes[top - 1]] < 2:
                continue
            chosen = _read(sizes, counts, reach, total, top)
            if chosen is None:
                continue
            read += 1
            fits = any(s <= room - total and counts[s] > chosen.count(s) for s in sizes[: 1 + len(chosen)])
            if not fits and not any(dominates(o, chosen) for o in out):
                out.append(chosen)
            if len(out) == FILLINGS or read == READ:
                return out or [chosen]
    return out


def _read(sizes: list[int], counts: dict[int, int], reach: list[int], total: int, top: int) -> tuple[int, ...] | None:
    """The filling of ``total`` whose largest item is the ``top``-th size, none if there is none."""
    chosen: list[int] = []
    j = top
    while total:
        s = sizes[j - 1]
        n = min(counts[s], total // s)
        below = reach[j - 1]
        while n and not below >> total - n * s & 1:
            n -= 1
        if not n and j == top:
            return None
        chosen += [s] * n
        total -= n * s
        # sizes above what is left are of no use
        j = min(j - 1, bisect_right(sizes, total))
    return tuple(chosen)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into the items of ``a`` as bins, by first fit."""
    room = sorted(a)
    for x in sorted(b, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            return False
        room[at] -= x
        room.sort()
    return True


def complete(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, for all pieces counted."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    first = best_fit(counts, capacity)
    best, bound = searched(counts, capacity, first)
    full = [p for p in first if sum(p[0]) == capacity]
    if sum(n for _, n in best) > bound and full:
        wasteful = [p for p in first if sum(p[0]) < capacity]
        rest: dict[int, int] = defaultdict(int)
        for pattern, n in wasteful:
            for s in pattern:
                rest[s] += n
        other = full + searched(dict(rest), capacity, wasteful)[0]
        best = min(best, other, key=lambda x: sum(n for _, n in x))
    return best


def searched(counts: dict[int, int], capacity: int, best: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(the best packing found, ``best`` if none is better; the lower bound)."""
    total = sum(s * n for s, n in counts.items())
    bound = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    used = sum(n for _, n in best)
    steps, most = 0, STEPS + PER_LENGTH * len(counts) ** 2
    # depth first; a branch is (counts left before its pattern, pattern, times, patterns so far, sequences so far, their waste)
    stack: list = [(counts, (), 0, None, 0, 0)]
    while stack and used > bound and steps < most:
        left, pattern, times, path, made, waste = stack.pop()
        if waste > (used - 1) * capacity - total:
            continue
        if times:
            left = {s: n - times * pattern.count(s) for s, n in left.items()}
            left = {s: n for s, n in left.items() if n}
            path = ((pattern, times), path)
        if not left:
            if made < used:
                used, best = made, []
                while path is not None:
                    best.append(path[0])
                    path = path[1]
            continue
        big = max(left)
        rest = dict(left)
        rest[big] -= 1
        room = capacity - big
        sizes = sorted(s for s, n in rest.items() if n and s <= room)
        steps += len(sizes) + READ
        # what a better packing may still waste
        slack = (used - 1) * capacity - total - waste
        for filling in reversed(fillings(sizes, rest, room, slack)):
            pattern = (big, *filling)
            times = min(left[s] // pattern.count(s) for s in set(pattern))
            gone = times * (capacity - sum(pattern))
            stack.append((left, pattern, times, path, made + times, waste + gone))
    return best, bound


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of slots, by rank."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for size in pattern:
            rows[size].append((taken[size], sequence, at))
            taken[size] += times
            at += size
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end: int = 0,
) -> DataFrame:
    """A row per piece with its sequence and its offset there.

    A null text is empty and a piece of one token, the end. Each of several rows of one id is packed
    as a document of its own. An empty table gives an empty result. Other columns are not carried.
    What reaches the driver is one count per length.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, doc_id, text, tokenizer, pattern, capacity, end), "pack-pieces")
    chunks = max(partitions(spark), pieces.count() // 50_000)
    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    counts = stored(chunked.groupBy("length", "_chunk").agg(F.count("*").alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    where = spark.sparkContext.broadcast(slots(complete(histogram, capacity)))

    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece")
    ranked = chunked.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["length", "_chunk"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).cast("bigint").alias("_rank")
    )

    def place(batches):
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, begin, place_ = where.value[int(s)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = begin[k] + rank[at] - first[k], place_[k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")
