"""Byte-pair encoding between forced boundaries, and decoding.

A merge only ever makes an entry of the vocabulary, so two neighbouring bytes that stand side by
side in no entry are never merged into one: between them lies a boundary whatever surrounds it. A
text is cut at such pairs, each distinct fragment is merged once by the ranks of the file and the
ids are put together again.

The file's splitting pattern, too, must see what it would see in the whole text. A space alone
between two characters that are not white space is a boundary of both kinds: no entry holds a space
behind another character, and the pattern never goes on over it. There whole texts are cut, column
by column; the pattern then runs over each distinct segment of a slice once, and the remaining
forced boundaries cut what it matched. A text with a space beside other white space is one segment.
Strings of special tokens are boundaries of a third kind, as their ids are taken before all else.
"""

from __future__ import annotations

import heapq
import json
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from spreadlake.llm.common import slices, utf8
from spreadlake.llm.packing import byte_alphabet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fragments whose ids a task remembers; the oldest half goes when they are more.
REMEMBERED = 200_000

#: Bytes from which a fragment's pairs wait in a heap; shorter ones are merged side by side, by length.
LONG = 64

#: White space of the splitting pattern, for a regular expression that runs over whole columns.
BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"

_NEVER = np.int32(2**31 - 1)


class Vocabulary:
    """Ids, ranks of merges and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        written = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in self.special}
        written |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank, made = {}, []
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault(ids[a] << 32 | ids[b], rank)
            made.append(ids[a + b])
        self.made = np.array(made, np.int64)
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int32, len(keys))[order]
        self.of_byte = np.array(self.of_byte, np.int64)
        self.byte_ranks = self.rank_of(self.of_byte[:, None], self.of_byte[None, :])
        # pairs of bytes side by side in some entry; all others are forced boundaries
        self.forced = np.ones((256, 256), bool)
        for i, b in written.items():
            if i not in self.special.values():
                row = np.frombuffer(b, np.uint8)
                self.forced[row[:-1], row[1:]] = False
        size = np.zeros(max(written, default=-1) + 1, np.int64)
        for i, b in written.items():
            size[i] = len(b)
        self.size = size
        self.bytes = np.frombuffer(b"".join(written[i] for i in sorted(written)), np.uint8)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; those that no merge makes have the largest number."""
        if not len(self.keys):
            return np.full(np.broadcast(a, b).shape, _NEVER)
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NEVER)

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of fragments: in each the pair of the least rank, leftmost first, is merged until none is left."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        out: list = [None] * len(parts)
        for least in range(0, LONG, 8):
            rows = np.flatnonzero((size >= least) & (size < least + 8))
            if len(rows):
                for k, ids in zip(rows, self._merge_alike([parts[k] for k in rows], size[rows], least + 8)):
                    out[k] = ids
        for k in np.flatnonzero(size >= LONG):
            out[k] = self._merge_long(self.of_byte[np.frombuffer(parts[k], np.uint8)].tolist())
        return out

    def _merge_alike(self, parts: list[bytes], size: np.ndarray, width: int) -> list[list[int]]:
        """Fragments of fewer than ``width`` bytes, one merge in each at a time."""
        n = len(parts)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, self.of_byte[raw], -1)
        ranks = np.full((n, width), _NEVER)
        ranks[:, :-1] = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], _NEVER)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = after - 2
        todo = np.arange(n)
        while len(todo):
            i = ranks[todo].argmin(axis=1)
            rank = ranks[todo, i]
            go = rank != _NEVER
            todo, i, rank = todo[go], i[go], rank[go]
            j = after[todo, i]
            k = after[todo, j]
            new = self.made[rank]
            ids[todo, i], ids[todo, j] = new, -1
            ranks[todo, j] = _NEVER
            after[todo, i] = k
            # a width of one more than the longest fragment leaves room for what stands behind the last id
            follows = np.where(k < width, ids[todo, np.minimum(k, width - 1)], -1)
            ranks[todo, i] = np.where(follows >= 0, self.rank_of(new, follows), _NEVER)
            before[todo[k < width], k[k < width]] = i[k < width]
            h = before[todo, i]
            left = h >= 0
            ranks[todo[left], h[left]] = self.rank_of(ids[todo[left], h[left]], new[left])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids; ids that the file doesn't know have none."""
        known = ids < len(self.size)
        size = np.where(known, self.size[np.where(known, ids, 0)], 0)
        start = np.cumsum(self.size) - self.size
        out = self.bytes[spans(start[np.where(known, ids, 0)], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:])]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .., one after the other."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def gathered(codes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that the codes name, one after the other, and the size of each."""
    start = np.cumsum(size) - size
    return flat[spans(start[codes], size[codes])], size[codes]


def grouped(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` consecutive sizes."""
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.concatenate(([0], np.cumsum(counts)))
    return ends[at[1:]] - ends[at[:-1]]


class Encoder:
    """Ids of slices of texts; remembers fragments from one slice to the next."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.matches = regex.compile(pattern).findall
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known: dict[bytes, list[int]] = {}

    def fragments(self, matched: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of what the pattern matched."""
        coded = pa.array(matched, pa.large_string()).dictionary_encode()
        data, off = utf8(coded.dictionary)
        data, off = data[off[0] : off[-1]], off - off[0]
        start = np.ones(len(data), bool)
        start[1:] = self.vocabulary.forced[data[:-1], data[1:]]
        start[off[:-1][np.diff(off) > 0]] = True
        at = np.append(np.flatnonzero(start), len(data))
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        named = parts.dictionary.to_pylist()
        new = [p for p in named if p not in self.known]
        made = dict(zip(new, self.vocabulary.merge(new)))
        each = [made[p] if p in made else self.known[p] for p in named]
        self.known |= {p: ids for p, ids in made.items() if len(p) < LONG}
        if len(self.known) > REMEMBERED:
            self.known = dict(list(self.known.items())[len(self.known) // 2 :])
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.uint32, int(size.sum()))
        ids, size = gathered(parts.indices.to_numpy(), flat, size)
        # fragments of one match follow each other
        size = grouped(size, np.diff(np.searchsorted(at[:-1], off)))
        return gathered(coded.indices.to_numpy(), ids, size)

    def segments(self, parts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of distinct segments, ``lead`` before each."""
        odd = pc.or_(pc.match_substring_regex(parts, BLANK), pc.equal(pc.binary_length(parts), 0)).to_numpy(zero_copy_only=False)
        # segments without white space go through the pattern as lines of one text
        words = parts.filter(pa.array(~odd)).to_pylist()
        matched = self.matches(lead + f"\n{lead}".join(words)) if words else []
        line = np.fromiter((m == "\n" for m in matched), bool, len(matched))
        counts = np.zeros(len(parts), np.int64)
        if words:
            counts[~odd] = np.diff(np.flatnonzero(line), prepend=-1, append=len(line)) - 1
        others = [self.matches(lead + w) for w in parts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(m) for m in others]
        ids, size = self.fragments([m for m in matched if m != "\n"] + list(chain.from_iterable(others)))
        # the matches stand by kind; bring them into the order of the segments
        first = np.zeros(len(parts), np.int64)
        first[~odd] = np.cumsum(counts[~odd]) - counts[~odd]
        first[odd] = int(counts[~odd].sum()) + np.cumsum(counts[odd]) - counts[odd]
        ids, size = gathered(spans(first, counts), ids, size)
        return ids, grouped(size, counts)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of texts without special tokens."""
        if not len(column):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        wide = pc.match_substring_regex(column, f"{BLANK} | {BLANK}")
        lists = pc.split_pattern(pc.if_else(wide, "", column), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at, flat = at - at[0], lists.flatten()
        head = np.zeros(len(flat), bool)
        head[at[:-1]] = True
        # a wide text stands whole where its first segment would
        whole = np.flatnonzero(wide.to_numpy(zero_copy_only=False))
        heads = pc.if_else(wide, column, flat.take(pa.array(at[:-1]))).dictionary_encode()
        tails = flat.filter(pa.array(~head)).dictionary_encode()
        code = np.empty(len(flat), np.int64)
        code[head] = heads.indices.to_numpy()
        code[~head] = tails.indices.to_numpy() + len(heads.dictionary)
        assert not len(whole) or (np.diff(at)[whole] == 1).all()
        ids_a, size_a = self.segments(heads.dictionary, "")
        ids_b, size_b = self.segments(tails.dictionary, " ")
        ids, size = gathered(code, np.concatenate((ids_a, ids_b)), np.concatenate((size_a, size_b)))
        return ids, grouped(size, np.diff(at))

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has); null is empty."""
        text = column.cast(pa.large_string()).fill_null("")
        if self.special is None:
            return self.texts(text)
        marked = np.zeros(len(text), bool)
        for token in self.vocabulary.special:
            marked |= pc.match_substring(text, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.texts(text)
        # texts with special tokens are cut at them; every second piece is one
        pieces, counts = [], np.ones(len(text), np.int64)
        for k, m in enumerate(marked):
            cut = self.special.split(text[k].as_py()) if m else [text[k].as_py()]
            counts[k] = len(cut)
            pieces += [(p, m and i % 2 == 1) for i, p in enumerate(cut)]
        ids, size = self.texts(pa.array(["" if s else p for p, s in pieces], pa.large_string()))
        own = np.array([self.vocabulary.special[p] if s else -1 for p, s in pieces], np.int64)
        out = np.empty(int(size.sum()) + int((own >= 0).sum()), np.uint32)
        each = size + (own >= 0)
        special = (np.cumsum(each) - each)[own >= 0]
        plain = np.ones(len(out), bool)
        plain[special] = False
        out[plain], out[special] = ids, own[own >= 0]
        return out, grouped(each, counts)


def encode(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text, packed as little-endian unsigned 32-bit numbers.

    A null or empty text has none. Repeated rows are encoded each, whatever their id, which may be
    null; an empty table gives an empty result; other columns are not carried. A very long text is a
    slice of its own; a fragment of any length takes time in proportion to it and its logarithm.
    ``tokenizer`` is read by the tasks and must be there on every machine.
    """

    def work(batches):
        encoder = Encoder(tokenizer, pattern)
        for part in slices(batches, 1, 1 << 21):
            ids, counts = encoder.batch(part.column(1))
            raw = ids.astype("<u4").tobytes()
            ends = np.concatenate(([0], np.cumsum(counts))) * 4
            packed = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text that packed ids spell; null has none, unknown ids spell nothing.

    Bytes that are no UTF-8 become replacement characters. A column already named ``decoded`` is
    replaced.
    """
    others = [c for c in encoded.columns if c not in (ids, "decoded")]
    boxed = encoded.select(F.struct(*others).alias("_row"), F.col(ids))
    schema = T.StructType([*boxed.schema.fields, T.StructField("decoded", T.StringType())])

    def work(batches):
        known = Vocabulary(tokenizer)
        for part in slices_of_bytes(batches, 1, 1 << 21):
            packed = part.column(1).fill_null(b"").to_pylist()
            counts = np.array([len(p) // 4 for p in packed], np.int64)
            every = np.frombuffer(b"".join(p[: len(p) // 4 * 4] for p in packed), "<u4")
            texts = [b.decode("utf-8", "replace") for b in known.decode(every, counts)]
            none = part.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string(), mask=none)], ["_row", ids, "decoded"]
            )

    return boxed.mapInArrow(work, schema).select(*[F.col("_row")[c].alias(c) for c in others], F.col(ids), "decoded")


def slices_of_bytes(batches, column: int, limit: int):
    """Batches cut so that the values of one slice hold about ``limit`` bytes; a longer one is alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, base + limit, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to
