"""A hierarchical Pitman-Yor language model over words.

The words that follow a context sit in its restaurant, those of one word at tables of their own;
each table is a customer of the parent restaurant. A context is the whole word before, or the start
of the text; its parent is the restaurant of that word's ending (its last two letters, hashed to
``CLASSES`` classes), whose parent is the one all contexts share, whose base is uniform over the
vocabulary and one unknown word. There are as many restaurants as the corpus has different words.

Seating is sampled by Gibbs: given the parent's predictive probabilities, the number of tables of a
word in a context has a known distribution, ``S(c, t) a**t`` with generalised Stirling numbers, and
is drawn anew from it, then the parent's numbers are, given those. A word that follows a context
once has one table there, always, so sweeps only draw for pairs seen twice or more.

Words are spread over shards by ranges of their hashes. A word's shard holds the seating of the word
in all its restaurants; as a context the word has its home in the same shard, which adds up the
tables of its restaurant. In a sweep every shard sends its tables by context to their homes, and
the homes send back the totals. Each sweep is a stored table, so none is done twice. The driver sees
only sums over the classes. What the last sweeps say is averaged: discounted counts, the
weight a context gives to its parent, and the parent's probabilities.

Shards and buckets follow from the size of the texts alone, so that a parcel between two of them does
not get smaller with more partitions. Texts are scored in buckets: a bucket asks the shards for its
distinct pairs, words and contexts. Buckets come in ``ROUNDS``; a round's texts, questions and answers
leave the disks with its end.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm.common import WordHasher, forget, mix, slices, stored, total_chars

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes of endings, the parents of the contexts; the start of a text is the last one. A power of two.
CLASSES = 32

#: Bits of a word's hash that tell contexts apart (words are told apart by all 64).
CONTEXT_BITS = 35

#: Sweeps of the sampler, and how many of the last ones are averaged.
SWEEPS, AVERAGED = 5, 3

#: Strength of all levels; discounts follow from how many words were counted once and twice.
STRENGTH = 1.0

#: Customers up to which the number of tables is drawn from its exact distribution.
EXACT = 40

_END = np.uint64(0x5851F42D4C957F2D)
_SHIFT, _CLASS_BITS = np.uint64(64 - CONTEXT_BITS), np.uint64(5)
_WIDTH = np.uint64(CONTEXT_BITS + 5)
_LOW = (np.uint64(1) << _WIDTH) - np.uint64(1)
_START = np.uint64(((0xD1342543DE82EF95 >> (64 - CONTEXT_BITS)) << 5) | (CLASSES - 1))
_FLUSH = 1 << 21

#: Characters of text behind a shard and in a bucket, and how many of either there are at least.
#: Half as many words at most, which can be numbered in the bits above a context.
SHARD_CHARS, FEWEST = 24_000_000, 16

#: Buckets are scored in so many turns, one after the other.
ROUNDS = 3

#: Groups of shards whose pairs a task sorts one after the other, which bounds its memory.
GROUPS = 8

#: What a parcel holds: counts of a shard, a sweep's seating, tables by context on their way to the
#: homes, totals on their way back, a home's contexts, their totals in a sweep, questions, answers.
#: Sweeps need less than all counts: the classes of each word, and the pairs seen twice or more.
MODEL, SEATS, REPEATED, STATE, TABLES, TOTALS, HOME, HOME_TOTALS, ASK, ANSWER = range(10)

PARCEL = "to int, origin int, kind int, sweep int, a binary, b binary, c binary, d binary, stats array<bigint>"
_TYPES = [pa.int32()] * 4 + [pa.binary()] * 4 + [pa.list_(pa.int64())]
_NAMES = ["to", "origin", "kind", "sweep", "a", "b", "c", "d", "stats"]


def parcels(rows: list[tuple]) -> pa.Table:
    """Rows of (to, origin, kind, sweep, up to four binaries, stats)."""
    columns = list(zip(*rows)) if rows else [[]] * 9
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def parcel(to: int, origin: int, kind: int, sweep: int, *binaries: bytes, stats: list[int] | None = None) -> tuple:
    return (int(to), int(origin), kind, sweep, *binaries, *[None] * (4 - len(binaries)), stats)


def opened(group: pa.Table) -> dict[int, list[dict]]:
    """Parcels by kind, each kind in order of sweep and origin."""
    out: dict[int, list[dict]] = {}
    for row in group.to_pylist():
        out.setdefault(row["kind"], []).append(row)
    for rows in out.values():
        rows.sort(key=lambda r: (r["sweep"], r["origin"]))
    return out


def word_pairs(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words and contexts of all tokens, number of tokens of each text); every text ends in one end token.

    The lowest bits of a context are the class of its ending.
    """
    hashes, counts = hasher.batch(column)
    n = counts + 1
    ends = np.cumsum(n) - 1
    word = np.full(int(n.sum()), _END, np.uint64)
    inside = np.ones(len(word), bool)
    inside[ends] = False
    word[inside] = hashes
    context = np.full(len(word), _START, np.uint64)
    ending = mix(hasher.ended.astype(np.uint64)) % np.uint64(CLASSES - 1)
    context[np.flatnonzero(inside) + 1] = ((hashes >> _SHIFT) << _CLASS_BITS) | ending
    return word, context, n


@dataclass
class Pairs:
    """Distinct (word, context) pairs in order: words, contexts per word, contexts, and how often each occurs."""

    words: np.ndarray
    sizes: np.ndarray
    contexts: np.ndarray
    times: np.ndarray
    place: np.ndarray | None = None

    @classmethod
    def of(cls, word: np.ndarray, context: np.ndarray, times: np.ndarray | None = None, places: bool = False) -> Pairs:
        """``places``: also where each given pair is among the distinct ones."""
        return cls._numbered(*np.unique(word, return_inverse=True), context, times, places)

    @classmethod
    def _numbered(cls, words: np.ndarray, number: np.ndarray, context: np.ndarray, times: np.ndarray | None, places: bool) -> Pairs:
        """From sorted words and, for each pair, the number of its word."""
        if len(words) > 1 << 64 - CONTEXT_BITS - 5:  # too many to be numbered in the bits above a context
            order = np.lexsort((context, number))
        else:
            key = (number.astype(np.uint64) << _WIDTH) | context
            if times is None and not places:
                return cls._of_keys(words, key)
            order = np.argsort(key)
            del key
        n, u = number[order], context[order]
        fresh = np.ones(len(n), bool)
        fresh[1:] = (n[1:] != n[:-1]) | (u[1:] != u[:-1])
        at = np.flatnonzero(fresh)
        place = None
        if places:
            place = np.empty(len(n), np.int64)
            place[order] = np.cumsum(fresh) - 1
        if times is not None:
            counts = np.add.reduceat(times[order], at) if len(at) else np.empty(0, np.int64)
        else:
            counts = np.diff(np.append(at, len(n)))
        return cls(words, np.bincount(n[at], minlength=len(words)), u[at], counts, place)

    @classmethod
    def _of_keys(cls, words: np.ndarray, key: np.ndarray) -> Pairs:
        """From word numbers and contexts in one number each."""
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        counts, key = np.diff(np.append(at, len(key))), key[at]
        return cls(words, np.bincount((key >> _WIDTH).astype(np.int64), minlength=len(words)), key & _LOW, counts)

    @classmethod
    def merged(cls, parts: list[Pairs], times: bool = False, places: bool = False) -> Pairs:
        """The distinct pairs of several; ``times`` adds up how often each occurs."""
        words = distinct(np.concatenate([p.words for p in parts]))
        number = np.concatenate([np.repeat(np.searchsorted(words, p.words), p.sizes) for p in parts])
        context = np.concatenate([p.contexts for p in parts])
        return cls._numbered(words, number, context, np.concatenate([p.times for p in parts]) if times else None, places)

    def by_shard(self, shards: int):
        """(shard, its pairs)."""
        edges = np.concatenate(([0], np.cumsum(self.sizes)))
        for s, a, b in by_shard(self.words >> _SHIFT, shards):
            yield s, Pairs(self.words[a:b], self.sizes[a:b], self.contexts[edges[a] : edges[b]], self.times[edges[a] : edges[b]])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        starts = np.cumsum(self.sizes) - self.sizes
        steps = self.contexts.copy()
        steps[1:] -= self.contexts[:-1]
        steps[starts] = self.contexts[starts]
        return pack_sorted(self.words), pack_counts(self.sizes), planes(steps, 5)

    @classmethod
    def unpacked(cls, words: bytes, sizes: bytes, contexts: bytes, times: bytes | None = None) -> Pairs:
        sizes_, steps = unpack_counts(sizes), unplanes(contexts, 5)
        starts = np.cumsum(sizes_) - sizes_
        total = np.cumsum(steps, dtype=np.uint64)
        total -= np.repeat(total[starts] - steps[starts], sizes_)
        return cls(unpack_sorted(words), sizes_, total, unpack_counts(times) if times is not None else np.empty(0, np.int64))

    def words_of(self) -> np.ndarray:
        """The number of each pair's word."""
        return np.repeat(np.arange(len(self.words)), self.sizes)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct (word, class) as word number * CLASSES + class, each pair's place among them)."""
        return np.unique(self.words_of() * CLASSES + (self.contexts % np.uint64(CLASSES)).astype(np.int64), return_inverse=True)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different numbers in order."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def planes(values: np.ndarray, width: int, size: int = 8) -> bytes:
    """The lowest ``width`` bytes of numbers of ``size`` bytes, byte by byte and compressed, behind their raw length."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T[:width].tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unplanes(packed: bytes, width: int, size: int = 8) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""
    out = np.zeros((len(raw) // width, size), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(np.uint64 if size == 8 else np.uint32).ravel()


def pack_floats(values: np.ndarray) -> bytes:
    """Numbers in single precision."""
    return planes(np.ascontiguousarray(values, np.float32), 4, 4)


def unpack_floats(raw: bytes) -> np.ndarray:
    return unplanes(raw, 4, 4).view(np.float32).astype(float)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences."""
    return planes(np.diff(values, prepend=np.uint64(0)), 8)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, 8), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return planes(values.astype(np.uint64), 6)


def unpack_counts(raw: bytes) -> np.ndarray:
    return unplanes(raw, 6).astype(np.int64)


def by_shard(hashes: np.ndarray, shards: int):
    """(shard, from, to) of the sorted leading bits of hashes; a shard is a range of them."""
    bounds = np.array([(s << CONTEXT_BITS) // shards for s in range(1, shards)], np.uint64)
    edges = np.concatenate(([0], np.searchsorted(hashes, bounds), [len(hashes)]))
    return [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def shard_groups(words: np.ndarray, shards: int) -> np.ndarray:
    """The group of neighbouring shards each word is in, so that pairs are sorted a group at a time."""
    edges = [(s << CONTEXT_BITS) // shards for s in sorted({k * shards // GROUPS for k in range(1, GROUPS)} - {0})]
    return np.searchsorted(np.array(edges, np.uint64) << _SHIFT, words, "right").astype(np.uint8)


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c and t up to ``most``: S(c + 1, t) = S(c, t - 1) + (c - t * discount) S(c, t)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = s[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300))
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.where(t <= c, stay, -np.inf))
    return s


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of ``c`` customers of one dish; ``a`` is the weight of a new table.

    Beyond ``EXACT`` customers, the others come in groups of a quarter of those seated, each group
    opening a binomial number of tables.
    """
    t = np.ones(len(c), np.int64)
    table = stirling(discount)
    log_a = np.log(np.maximum(a, 1e-300))
    few = np.minimum(c, EXACT)
    order = np.argsort(few, kind="stable")
    edges = np.searchsorted(few[order], np.arange(2, EXACT + 2))
    for size, begin, end in zip(range(2, EXACT + 1), edges[:-1], edges[1:]):
        for lo in range(begin, end, 200_000):
            at = order[lo : min(end, lo + 200_000)]
            w = table[size, 1 : size + 1] + log_a[at, None] * np.arange(1, size + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (w < (rng.random(len(at)) * w[:, -1])[:, None]).sum(axis=1)
    at, seated = np.flatnonzero(c > EXACT), np.empty(0)
    seated = np.full(len(at), EXACT, np.int64)
    while len(at):
        group = np.minimum(np.maximum(seated // 4, 1), c[at] - seated)
        t[at] += rng.binomial(group, a[at] / (seated - discount * t[at] + a[at]))
        seated = seated + group
        more = seated < c[at]
        at, seated = at[more], seated[more]
    return t


@dataclass
class Sums:
    """Sums over all shards after a sweep: customers and tables per class and of the root, the discounts of the three levels."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    discount: float
    class_discount: float
    root_discount: float

    @classmethod
    def of(cls, stats: list[int]) -> Sums:
        def discount(once: int, twice: int) -> float:
            return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

        k = 2 * CLASSES
        return cls(
            np.array(stats[:CLASSES], float), np.array(stats[CLASSES:k], float), float(stats[k]), float(stats[k + 1]),
            *(discount(*stats[at : at + 2]) for at in (k + 2, k + 4, k + 6)),
        )


N_STATS = 2 * CLASSES + 10


class Seating:
    """Tables of a shard's words per pair seen twice or more, per class, and at the root.

    ``keys`` are word numbers and classes as word * CLASSES + class, ``once`` how many pairs seen once
    each has, ``repeated`` the other pairs, ``fixed`` what a sweep does not change of ``stats``.
    """

    def __init__(self, keys: np.ndarray, once: np.ndarray, repeated: Pairs, fixed: list[int], number: int, vocabulary: int, seed: int = 17):
        self.keys, self.once, self.times, self.fixed, self.number, self.seed = keys, once, repeated.times, fixed, number, seed
        self.repeated = repeated
        self.word, self.cls, self.n_words = keys // CLASSES, keys % CLASSES, fixed[-1]
        own = np.repeat(repeated.words.astype(np.int64), repeated.sizes) * CLASSES + (repeated.contexts % np.uint64(CLASSES)).astype(np.int64)
        self.key = np.searchsorted(keys, own)
        self.base = 1.0 / (vocabulary + 1)
        self.seat(np.ones(len(self.times), np.int64), np.ones(len(keys), np.int64), np.ones(self.n_words, np.int64))

    @classmethod
    def opened(cls, seats: dict, repeated: dict, number: int, vocabulary: int) -> Seating:
        sizes = unpack_counts(seats["a"])
        keys = np.repeat(np.arange(len(sizes)), sizes) * CLASSES + np.frombuffer(seats["b"], np.uint8)
        pairs = Pairs.unpacked(*(repeated[c] for c in "abcd"))
        return cls(keys, unpack_counts(seats["c"]), pairs, seats["stats"], number, vocabulary)

    @cached_property
    def _contexts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.repeated.contexts, return_inverse=True)

    @property
    def contexts(self) -> np.ndarray:
        """The contexts of the repeated pairs."""
        return self._contexts[0]

    @property
    def context(self) -> np.ndarray:
        """Which of them each repeated pair has."""
        return self._contexts[1]

    def seat(self, tables: np.ndarray, class_tables: np.ndarray, root_tables: np.ndarray) -> None:
        self.tables, self.class_tables, self.root_tables = tables, class_tables, root_tables
        self.customers = self.once + np.bincount(self.key, tables, len(self.keys)).astype(np.int64)
        self.root_customers = np.bincount(self.word, class_tables, self.n_words).astype(np.int64)

    def seating(self) -> tuple[bytes, bytes, bytes]:
        return tuple(pack_counts(t) for t in (self.tables, self.class_tables, self.root_tables))

    def unseen(self, g: Sums) -> float:
        """What the root gives to any word for tables yet to open."""
        return (STRENGTH + g.root_discount * g.root_tables) / (STRENGTH + g.root_customers) * self.base

    def root_probability(self, g: Sums) -> np.ndarray:
        return (self.root_customers - g.root_discount * self.root_tables) / (STRENGTH + g.root_customers) + self.unseen(g)

    def class_probability(self, g: Sums) -> np.ndarray:
        seen = (self.customers - g.class_discount * self.class_tables) / (STRENGTH + g.customers[self.cls])
        return seen + class_weight(g)[self.cls] * self.root_probability(g)[self.word]

    def sweep(self, number: int, g: Sums, totals: np.ndarray) -> None:
        """Draw all tables anew; ``totals`` has the tables of each of ``contexts``."""
        rng = np.random.default_rng([self.seed, self.number, number])
        a = (STRENGTH + g.discount * totals[self.context]) * self.class_probability(g)[self.key]
        tables = draw_tables(self.times, a, g.discount, rng)
        self.seat(tables, self.class_tables, self.root_tables)
        a = (STRENGTH + g.class_discount * g.tables[self.cls]) * self.root_probability(g)[self.word]
        self.seat(tables, draw_tables(self.customers, a, g.class_discount, rng), self.root_tables)
        a = np.full(self.n_words, (STRENGTH + g.root_discount * g.root_tables) * self.base)
        self.root_tables = draw_tables(self.root_customers, a, g.root_discount, rng)

    def stats(self) -> list[int]:
        def both(x: np.ndarray) -> list[int]:
            return [int((x == k).sum()) for k in (1, 2)]

        sums = [np.bincount(self.cls, x, CLASSES).astype(np.int64).tolist() for x in (self.customers, self.class_tables)]
        return [
            *sums[0], *sums[1], int(self.root_customers.sum()), int(self.root_tables.sum()), *self.fixed[:2], *both(self.customers),
            *both(self.root_customers), *self.fixed[2:],
        ]


class Shard(Seating):
    """A shard with all its counts."""

    def __init__(self, pairs: Pairs, number: int, vocabulary: int, seed: int = 17):
        self.pairs = pairs
        keys, of = pairs.classes()
        self.active = np.flatnonzero(pairs.times >= 2)
        word, at = np.unique(pairs.words_of()[self.active], return_counts=True)
        repeated = Pairs(word.astype(np.uint64), at, pairs.contexts[self.active], pairs.times[self.active])
        fixed = [int((pairs.times == 1).sum()), int((pairs.times == 2).sum()), int(pairs.times.sum()), len(pairs.words)]
        super().__init__(keys, np.bincount(of[pairs.times == 1], minlength=len(keys)), repeated, fixed, number, vocabulary, seed)

    def closed(self, to: int) -> list[tuple]:
        """The parcels of the shard."""
        sizes = np.bincount(self.word, minlength=self.n_words)
        return [
            parcel(to, 0, MODEL, 0, *self.pairs.packed(), pack_counts(self.pairs.times), stats=self.stats()),
            parcel(to, 0, SEATS, 0, pack_counts(sizes), self.cls.astype(np.uint8).tobytes(), pack_counts(self.once), stats=self.fixed),
            parcel(to, 0, REPEATED, 0, *self.repeated.packed(), pack_counts(self.repeated.times)),
        ]

    def counts(self, words: np.ndarray) -> np.ndarray:
        at, known = _find(self.pairs.words, words)
        total = np.bincount(self.pairs.words_of(), self.pairs.times, len(self.pairs.words)).astype(np.int64)
        return np.where(known, total[at] if len(total) else 0, 0)

    def places(self, asked: Pairs) -> tuple:
        """Where what is asked for is in the shard; the same in all sweeps."""
        at, known = _find(self.pairs.words, asked.words)
        keys, _ = asked.classes()
        word = keys // CLASSES
        return at, known, keys, *_find(self.keys, np.where(known[word], at[word] * CLASSES + keys % CLASSES, -1)), self._pairs(asked, at, known)

    def answer(self, asked: Pairs, g: Sums, places: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(discounted count of each pair asked for, probability its class gives to each of the words' classes)."""
        at, known, keys, place, here, pair = places or self.places(asked)
        word, cls = keys // CLASSES, keys % CLASSES
        root = np.full(len(asked.words), self.unseen(g))
        root[known] = self.root_probability(g)[at[known]]
        below = class_weight(g)[cls] * root[word]
        seen = self.customers - g.class_discount * self.class_tables
        below[here] += seen[place[here]] / (STRENGTH + g.customers[cls[here]])
        tables = np.ones(len(self.pairs.times), np.int64)
        tables[self.active] = self.tables
        return np.append(self.pairs.times - g.discount * tables, 0.0)[pair], below

    def _pairs(self, asked: Pairs, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Where each pair asked for is among the shard's own; the number of those if it is not."""
        own, n = self.pairs, len(self.pairs.contexts)
        of = asked.words_of()
        mine, theirs = ((w.astype(np.uint64) << _WIDTH) | p.contexts for w, p in ((own.words_of(), own), (at[of], asked)))
        place, here = _find(mine, theirs)
        return np.where(here & known[of], place, n)


def class_weight(g: Sums) -> np.ndarray:
    """What each class gives to the root."""
    return (STRENGTH + g.class_discount * g.tables) / (STRENGTH + g.customers)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def _add_up(df: DataFrame) -> list[int]:
    return [int(x or 0) for x in df.agg(*[F.sum(F.col("stats")[i]) for i in range(N_STATS)]).first()]


def counted(docs: DataFrame, text: str, shards: int) -> DataFrame:
    """All (context, word) pairs of the texts and how often they occur, three parcels per shard."""

    def send(held):
        word, context = (np.concatenate(x) for x in zip(*held))
        held.clear()
        of = shard_groups(word, shards)
        for k in range(GROUPS):
            pairs = Pairs.of(word[of == k], context[of == k])
            rows = [parcel(s, 0, MODEL, 0, *p.packed(), pack_counts(p.times)) for s, p in pairs.by_shard(shards)]
            yield from parcels(rows).to_batches()

    def part(batches):
        hasher, held, size = WordHasher(lower=True, endings=True), [], 0
        for b in slices(batches, 0, 1 << 20):
            held.append(word_pairs(b.column(0), hasher)[:2])
            size += len(held[-1][0])
            if size >= _FLUSH:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def merge(group: pa.Table) -> pa.Table:
        pairs = Pairs.merged([Pairs.unpacked(r["a"], r["b"], r["c"], r["d"]) for r in group.to_pylist()], times=True)
        return parcels(Shard(pairs, 0, 0).closed(group.column("to")[0].as_py()))

    return docs.select(F.col(text)).mapInArrow(part, PARCEL).groupBy("to").applyInArrow(merge, PARCEL)


def _shard(boxes: dict[int, list[dict]], number: int, vocabulary: int) -> Shard:
    rows = boxes.get(MODEL)
    if not rows:
        none = np.empty(0, np.uint64)
        return Shard(Pairs(none, np.empty(0, np.int64), none, np.empty(0, np.int64)), number, vocabulary)
    return Shard(Pairs.unpacked(*(rows[0][c] for c in "abcd")), number, vocabulary)


def _tables_home(own: Seating, sweep: int, shards: int) -> list[tuple]:
    """A shard's tables by context, addressed to the contexts' homes."""
    sums = np.bincount(own.context, own.tables, len(own.contexts)).astype(np.int64)
    return [
        parcel(home, own.number, TABLES, sweep, pack_sorted(own.contexts[a:b]), pack_counts(sums[a:b]))
        for home, a, b in by_shard(own.contexts >> _CLASS_BITS, shards)
    ]


def at_home(model: DataFrame, shards: int) -> DataFrame:
    """Of each home its contexts, with customers and tables of pairs seen once, and the first totals back."""

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                pairs = Pairs.unpacked(*(row[c] for c in "abcd"))
                contexts, of = np.unique(pairs.contexts, return_inverse=True)
                customers = np.bincount(of, pairs.times, len(contexts)).astype(np.int64)
                once, more = (np.bincount(of[at], minlength=len(contexts)) for at in (pairs.times == 1, pairs.times > 1))
                rows = []
                for home, x, y in by_shard(contexts >> _CLASS_BITS, shards):
                    counts = (pack_counts(v[x:y]) for v in (customers, once, more))
                    rows.append(parcel(home, row["to"], TABLES, 0, pack_sorted(contexts[x:y]), *counts))
                yield from parcels(rows).to_batches()

    def settle(group: pa.Table) -> pa.Table:
        home = group.column("to")[0].as_py()
        sent = [(r["origin"], unpack_sorted(r["a"]), *(unpack_counts(r[c]) for c in "bcd")) for r in opened(group)[TABLES]]
        contexts, of = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True)
        customers, once, more = (np.bincount(of, np.concatenate([s[i] for s in sent]), len(contexts)).astype(np.int64) for i in (2, 3, 4))
        rows = [parcel(home, home, HOME, 0, pack_sorted(contexts), pack_counts(customers), pack_counts(once))]
        for origin, asked, _, _, active in sent:
            if active.any():
                at = np.searchsorted(contexts, asked[active > 0])
                rows.append(parcel(origin, home, TOTALS, 0, pack_counts((once + more)[at])))
        return parcels(rows)

    return model.mapInArrow(send, PARCEL).groupBy("to").applyInArrow(settle, PARCEL)


def swept(seats: DataFrame, before: DataFrame, g: Sums, number: int, shards: int, vocabulary: int) -> DataFrame:
    """One sweep: each shard's new seating, and its tables by context for their homes."""

    def work(group: pa.Table) -> pa.Table:
        boxes = opened(group)
        own = Seating.opened(boxes[SEATS][0], boxes[REPEATED][0], group.column("to")[0].as_py(), vocabulary)
        for row in boxes.get(STATE, []):
            own.seat(*(unpack_counts(row[c]) for c in "abc"))
        totals = [unpack_counts(r["a"]) for r in boxes.get(TOTALS, [])]
        own.sweep(number, g, np.concatenate(totals) if totals else np.empty(0, np.int64))
        return parcels([parcel(own.number, own.number, STATE, number, *own.seating(), stats=own.stats()), *_tables_home(own, number, shards)])

    return seats.unionByName(before).groupBy("to").applyInArrow(work, PARCEL)


def totalled(homes: DataFrame, sent: DataFrame, number: int) -> DataFrame:
    """Totals of the contexts after a sweep, kept at home and sent to the shards that asked."""

    def work(group: pa.Table) -> pa.Table:
        boxes = opened(group)
        home = boxes[HOME][0]
        contexts, tables = unpack_sorted(home["a"]), unpack_counts(home["c"])
        asked = []
        for row in boxes.get(TABLES, []):
            at = np.searchsorted(contexts, unpack_sorted(row["a"]))
            tables[at] += unpack_counts(row["b"])
            asked.append((row["origin"], at))
        rows = [parcel(home["to"], home["to"], HOME_TOTALS, number, pack_counts(tables))]
        return parcels(rows + [parcel(origin, home["to"], TOTALS, number, pack_counts(tables[at])) for origin, at in asked])

    return homes.unionByName(sent).groupBy("to").applyInArrow(work, PARCEL)


def shards_for(chars: int) -> int:
    """How many shards, and buckets, texts of so many characters are dealt to."""
    return max(FEWEST, math.ceil(chars / SHARD_CHARS))


def score_texts(docs: DataFrame, taught: Column, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, ``keep``) of every text.

    ``score`` is the log10 probability of the text's tokens, learned from the texts where ``taught``
    is true; ``base_score`` that of a smoothed unigram model. Null and empty texts are one end
    token. Repeated rows are learned from and scored each. With nothing to learn from, a token has
    probability 1, the unknown word being the only one. An empty table gives an empty result.
    """
    shards = buckets = shards_for(total_chars(docs, text))
    counts = stored(counted(docs.filter(taught), text, shards), "lm-counts", "kind")
    model, seats = counts.filter(F.col("kind") == MODEL), counts.filter(F.col("kind") != MODEL)
    stats = _add_up(model)
    tokens, vocabulary = stats[-2:]
    history = [Sums.of(stats)]

    homes = stored(at_home(model, shards), "lm-homes")
    back, kept_at_home = homes.filter(F.col("kind") == TOTALS), homes.filter(F.col("kind") == HOME)
    seating, states, totals = None, [], []
    for k in range(SWEEPS):
        before = back if seating is None else back.unionByName(seating)
        done = stored(swept(seats, before, history[-1], k, shards, vocabulary), "lm-sweep")
        seating = done.filter(F.col("kind") == STATE)
        history.append(Sums.of(_add_up(seating)))
        settled = stored(totalled(kept_at_home, done.filter(F.col("kind") == TABLES), k), "lm-totals")
        back = settled.filter(F.col("kind") == TOTALS)
        states.append(seating)
        totals.append(settled.filter(F.col("kind") == HOME_TOTALS))

    # what only the sweeps read
    for early in (*states[:-AVERAGED], *totals[:-AVERAGED]):
        forget(early)
    forget(counts, f"/kind={MODEL}/")

    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *kept)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(buckets)).cast("int"))
    bucket_at = len(keep) + 2

    def ask(batches):
        hasher, held = WordHasher(lower=True, endings=True), {}
        for b in slices(batches, 1, 1 << 20):
            of = b.column(bucket_at).to_numpy()
            for bucket in np.unique(of):
                part = b.filter(pa.array(of == bucket))
                held.setdefault(int(bucket), []).append(Pairs.of(*word_pairs(part.column(1), hasher)[:2]))
        for bucket in list(held):
            pairs = Pairs.merged(held.pop(bucket))
            contexts = distinct(pairs.contexts)
            asked = {s: p.packed() for s, p in pairs.by_shard(shards)}
            del pairs
            wanted = {s: pack_sorted(contexts[x:y]) for s, x, y in by_shard(contexts >> _CLASS_BITS, shards)}
            rows = [parcel(s, bucket, ASK, 0, *asked.get(s, (b"", b"", b"")), wanted.get(s, b"")) for s in sorted(asked.keys() | wanted)]
            yield from parcels(rows).to_batches()

    def answer(group: pa.Table) -> pa.Table:
        boxes = opened(group)
        if ASK not in boxes:
            return parcels([])
        number = group.column("to")[0].as_py()
        own = _shard(boxes, number, vocabulary)
        asked = [Pairs.unpacked(*(r[c] for c in "abc")) for r in boxes[ASK]]
        every = Pairs.merged(asked, places=True)
        places = own.places(every)
        counts, keys = own.counts(every.words), places[2]
        seen, below, last = np.zeros(len(every.contexts)), np.zeros(len(keys)), history[-AVERAGED:]
        for i, g in enumerate(last):
            if STATE in boxes:
                own.seat(*(unpack_counts(boxes[STATE][i][c]) for c in "abc"))
            s, b = own.answer(every, g, places)
            seen += s / AVERAGED
            below += b / AVERAGED
        contexts, share, weight = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        if HOME in boxes:
            home = boxes[HOME][0]
            contexts, share = unpack_sorted(home["a"]), 1 / (STRENGTH + unpack_counts(home["b"]))
            tables = sum(g.discount * unpack_counts(r["a"]) for g, r in zip(last, boxes[HOME_TOTALS])) / AVERAGED
            weight = (STRENGTH + tables) * share
        rows, begin = [], 0
        for row, p in zip(boxes[ASK], asked):
            at = every.place[begin : begin + len(p.contexts)]
            begin += len(at)
            words = np.searchsorted(every.words, p.words)
            own_keys, _ = p.classes()
            at_keys = np.searchsorted(keys, words[own_keys // CLASSES] * CLASSES + own_keys % CLASSES)
            found, known = _find(contexts, unpack_sorted(row["d"]))
            both = np.stack((np.full(len(found), 1 / STRENGTH), np.ones(len(found))))
            both[:, known] = share[found[known]], weight[found[known]]
            rows.append(
                parcel(
                    row["origin"], number, ANSWER, 0, pack_floats(seen[at]), pack_floats(below[at_keys]), pack_counts(counts[words]),
                    pack_floats(both),
                )
            )
        return parcels(rows)

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], t) for t in kinds_of], names=names_of)
        word, context, n = word_pairs(group.column("_text").combine_chunks(), WordHasher(lower=True, endings=True))
        pairs = Pairs.of(word, context, places=True)
        del word, context
        got = opened(answers)[ANSWER]
        seen, below = (np.concatenate([unpack_floats(r[c]) for r in got]) for c in "ab")
        share, weight = np.concatenate([unpack_floats(r["d"]).reshape(2, -1) for r in got], axis=1)
        of_context = np.unique(pairs.contexts, return_inverse=True)[1]
        p = seen * share[of_context]
        weight = weight[of_context]
        del seen, share, of_context
        p += weight * below[pairs.classes()[1]]
        del weight, below
        logs = np.log10(np.maximum(p, 1e-45))[pairs.place]
        del p
        counts = np.concatenate([unpack_counts(r["c"]) for r in got])[pairs.words_of()]
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (vocabulary + 1)))[pairs.place]
        known = (counts > 0)[pairs.place]
        del counts, got
        of = np.repeat(np.arange(len(n)), n)
        return pa.table(
            [
                group.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.bincount(of, known, len(n)).astype(np.int64)),
                pa.array(np.full(len(n), tokens, np.int64)), pa.array(np.bincount(of, base, len(n))), pa.array(np.bincount(of, logs, len(n))),
                *(group.column(f"_keep_{c}") for c in keep),
            ],
            names=names_of,
        )

    names_of = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", *keep]
    kinds_of = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.null()] * len(keep)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    kinds = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double" + kinds
    learned = model.unionByName(kept_at_home)
    for part in (*states[-AVERAGED:], *totals[-AVERAGED:]):
        learned = learned.unionByName(part)

    def scored(some: DataFrame) -> DataFrame:
        answers = learned.unionByName(some.mapInArrow(ask, PARCEL)).groupBy("to").applyInArrow(answer, PARCEL).withColumnRenamed("to", "_bucket")
        return some.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(score, kinds)

    done = None
    for k in range(ROUNDS):
        turn = rows.filter(F.col("_bucket") % ROUNDS == k).repartition(math.ceil(buckets / ROUNDS), "_bucket")
        part = stored(scored(turn), "lm-scores")
        done = part if done is None else done.unionByName(part)
    for part in (counts, homes, *states[-AVERAGED:], *totals[-AVERAGED:]):
        forget(part)
    return done
