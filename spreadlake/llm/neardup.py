"""Near duplicates among embeddings: sorted projection passes.

A pass gives every vector a key of 64 random hyperplane sides and sorts the vectors of a label by
it, so that vectors at a small angle, which agree on most sides, are likely to stand close. Every
vector is compared with the ones at most ``WINDOW`` to ``2 * WINDOW`` places away. Pairs found in
any pass are united. How many passes a label takes is measured: in ``TRIALS`` passes of keys alone,
the most leading sides that two keys a window apart still share say how many sides separate windows
where the label is densest. Two vectors at the threshold agree on so many sides with a known chance,
and passes are added until all but ``MISSED`` of such pairs are met. A label whose passes would
compare a vector as often as all others do, such as a small one or a dense cluster below the
threshold, is compared whole, in blocks, and misses nothing.

Equal vectors are one before the passes. Counts of links come last: inside a component all pairs
are compared in blocks, so that a group larger than a window loses no link.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from spreadlake.llm.common import partitions, stored
from spreadlake.llm.graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Neighbours compared, pairs at the threshold that all passes together may miss, and vectors per block of a component.
WINDOW, MISSED, BLOCK = 128, 1e-4, 1024

#: Passes of keys that are measured, sides of a key, and rows of a tile compared at once.
TRIALS, SIDES, TILE = 4, 64, 512

#: Labels are broadcast up to so many; beyond, the join is left to the optimizer.
BROADCAST_LABELS = 50_000

#: A row of a pass; the vector travels as the bytes of its doubles.
_ROW = "pass int, label string, dim int, key bigint, id bigint, v binary"


def passes_for(largest: int, threshold: float, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes for a label that hyperplanes halve evenly: no label needs fewer."""
    return passes_of_sides(max(0.0, math.log2(max(largest, 1) / window)), threshold, missed)


def passes_of_sides(sides: float, threshold: float, missed: float = MISSED) -> float:
    """Passes that leave a pair which must agree on ``sides`` unmet with a chance of at most ``missed``.

    Keys that share all sides are told apart by none: no number of passes is enough.
    """
    if sides >= SIDES:
        return math.inf
    met = (1 - math.acos(threshold) / math.pi) ** sides
    return 1 if met > 1 - missed else math.ceil(math.log(missed) / math.log1p(-met))


def _by_dim(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each number of components in a column of lists without nulls."""
    flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    off = off - off[0]
    dim = np.diff(off)
    return [(at, flat[off[at][:, None] + np.arange(d)]) for d in np.unique(dim) for at in [np.flatnonzero(dim == d)]]


def _keys(vectors: list[tuple[np.ndarray, np.ndarray]], n: int, number: int, seed: int, planes: dict) -> np.ndarray:
    """Sides of each vector in one pass, the first one in the highest bit, as numbers in order."""
    key = np.zeros(n, np.uint64)
    for at, v in vectors:
        d = v.shape[1]
        if (number, d) not in planes:
            planes[number, d] = np.random.default_rng([seed, number, d]).standard_normal((d, SIDES))
        key[at] = np.packbits(v @ planes[number, d] > 0, axis=1).view(">u8").ravel()
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _stretches(batches):
    """((pass, label, dim), rows) of each stretch of a sorted stream that lies in one batch."""
    for b in batches:
        if not b.num_rows:
            continue
        fresh = np.zeros(b.num_rows, bool)
        fresh[0] = True
        for column in (b.column(0), b.column(1).dictionary_encode().indices, b.column(2)):
            x = column.to_numpy()
            fresh[1:] |= x[1:] != x[:-1]
        at = np.append(np.flatnonzero(fresh), b.num_rows).tolist()
        for begin, end in zip(at[:-1], at[1:]):
            yield tuple(b.column(i)[begin].as_py() for i in range(3)), b.slice(begin, end - begin)


def shared_sides(keys: np.ndarray, window: int) -> int:
    """The most leading sides, and one, that two of the sorted keys ``window`` places apart share."""
    if len(keys) <= window:
        return 0
    differ = keys[window:].view(np.uint64) ^ keys[:-window].view(np.uint64)
    least = int(differ.min())
    return SIDES - least.bit_length() + 1 if least else SIDES


def sides_measured(vectors: DataFrame, window: int, seed: int = 9) -> DataFrame:
    """(label, dim, n, sides): vectors of each label and the sides that separate its windows where it is densest.

    The key of a trial travels without its vector. Ranges of keys are measured inside, and the keys
    beside their ends once more in one row of keys per label, so that no window is left out.
    """

    def keyed(batches):
        planes: dict = {}
        for b in batches:
            n, rows = b.num_rows, _by_dim(b.column(2))
            for p in range(TRIALS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, p, np.int32)), b.column(0), b.column(1), pa.array(_keys(rows, n, p, seed, planes))], ["pass", "label", "dim", "key"]
                )

    def longest(batches):
        """The sides of each label's stretch in one range, and its first and last keys."""
        held: tuple = (None, [])
        out: list[tuple] = []

        def done():
            keys = np.concatenate(held[1])
            ends = keys if len(keys) <= 2 * window else np.concatenate((keys[:window], keys[-window:]))
            out.append((*held[0], shared_sides(keys, window), ends.tolist()))

        for group, rows in _stretches(batches):
            if held[0] != group:
                if held[0]:
                    done()
                held = (group, [])
            held[1].append(rows.column(3).to_numpy())
        if held[0]:
            done()
            types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["pass", "label", "dim", "sides", "ends"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.sort(np.concatenate([np.asarray(x, np.int64) for x in pdf.ends]))
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "dim": [pdf.dim.iloc[0]], "sides": [max(int(pdf.sides.max()), shared_sides(ends, window))]})

    keys = vectors.select("label", "dim", "v").mapInArrow(keyed, "pass int, label string, dim int, key bigint")
    order = ["pass", "label", "dim", "key"]
    ranged = keys.repartitionByRange(max(partitions(vectors.sparkSession), 1), *order).sortWithinPartitions(*order)
    ranges = ranged.mapInArrow(longest, "pass int, label string, dim int, sides int, ends array<bigint>")
    sides = ranges.groupBy("pass", "label", "dim").applyInPandas(across, "label string, dim int, sides int").groupBy("label", "dim").agg(F.max("sides").alias("sides"))
    return vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).join(sides, ["label", "dim"])


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links between ``a`` and ``b``; a root is the smallest member."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def met_in_blocks(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): trees over the vectors of each label that are linked, all pairs compared; ``vectors`` also has n."""
    n = 4 * partitions(vectors.sparkSession)
    cut = vectors.withColumn("_blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = cut.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    group = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("label", "dim"), F.lit(n))).otherwise(F.xxhash64("label", "dim", "_lo", "_hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [[], []]
        for _, rows in pdf.groupby(["label", "dim", "_lo", "_hi"]):
            v, ids = np.array(rows.v.tolist()), rows.id.to_numpy()
            root = np.arange(len(v))
            for at in range(0, len(v), TILE):
                a, b = np.nonzero(v[at : at + TILE] @ v[at:].T >= threshold)
                root = _joined(root, a + at, b + at)
            own = np.flatnonzero(root != np.arange(len(root)))
            found[0].extend(ids[own])
            found[1].extend(ids[root[own]])
        return pd.DataFrame({"a": np.array(found[0], np.int64), "b": np.array(found[1], np.int64)})

    return cut.select("label", "dim", "id", "v", "_lo", "_hi", group.alias("_group")).groupBy("_group").applyInPandas(compare, "a bigint, b bigint")


def met_in_passes(vectors: DataFrame, threshold: float, window: int, seed: int = 9) -> DataFrame:
    """(a, b): trees over the vectors that the passes unite; ``vectors`` has label, dim, id, v and its label's passes."""

    def keyed(batches):
        planes: dict = {}
        for b in batches:
            passes, rows = b.column(4).to_numpy(), _by_dim(b.column(3))
            raw: list = [b""] * b.num_rows
            for at, v in rows:
                for k, x in zip(at.tolist(), v):
                    raw[k] = x.tobytes()
            packed = pa.array(raw, pa.binary())
            for p in range(int(passes.max()) if len(passes) else 0):
                key, mine = pa.array(_keys(rows, b.num_rows, p, seed, planes)), pa.array(passes > p)
                columns = [pa.array(np.full(b.num_rows, p, np.int32)), b.column(0), b.column(1), key, b.column(2), packed]
                yield pa.RecordBatch.from_arrays(columns, ["pass", "label", "dim", "key", "id", "v"]).filter(mine)

    def compared(batches):
        """Links of one range, and its first and last rows for the ranges beside it."""
        part = TaskContext.get().partitionId()
        group, first = None, True  # of the rows held; whether the range's first rows are still to be sent
        ids, v = np.empty(0, np.int64), np.empty((0, 0))

        def links(found: list[tuple]):
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.string(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], ["a", "b", "edge", "place", "v"])

        def edge(number: int, ids: np.ndarray, v: np.ndarray):
            n, place = len(ids), "/".join(map(str, group))
            columns = [pa.array(ids), pa.nulls(n, pa.int64()), pa.array(np.full(n, number, np.int64)), pa.array([place] * n), pa.array([x.tobytes() for x in v], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "edge", "place", "v"])

        def windows(last: bool) -> tuple[int, list[tuple]]:
            """Rows done with, and the links of the windows over the rows held."""
            at, found = 0, []
            while len(ids) - at >= 2 * window:
                found.append(_linked_rows(ids[at : at + 2 * window], v[at : at + 2 * window], threshold, window))
                at += window
            if last:
                found.append(_linked_rows(ids[at:], v[at:], threshold, len(ids) - at))
            return at, found

        for fresh, rows in _stretches(batches):
            if group != fresh:
                if group:
                    if first:
                        yield edge(part, ids[:window], v[:window])
                        first = False
                    yield links(windows(True)[1])
                group, ids, v = fresh, np.empty(0, np.int64), np.empty((0, fresh[2]))
            bytes_ = b"".join(rows.column(5).to_pylist())
            ids, v = np.concatenate((ids, rows.column(4).to_numpy())), np.concatenate((v, np.frombuffer(bytes_).reshape(-1, fresh[2])))
            if first and len(ids) >= window:
                yield edge(part, ids[:window], v[:window])
                first = False
            done, found = windows(False)
            if found:
                yield links(found)
                ids, v = ids[done:], v[done:]
        if group:
            if first:
                yield edge(part, ids, v)
            yield links(windows(True)[1])
            yield edge(part + 1, ids[-window:], v[-window:])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [[], []]
        for _, rows in pdf.groupby("place"):
            v = np.frombuffer(b"".join(rows.v)).reshape(len(rows), -1)
            a, b = _linked_rows(rows.a.to_numpy(np.int64), v, threshold, len(rows))
            found[0].extend(a)
            found[1].extend(b)
        return pd.DataFrame({"a": np.array(found[0], np.int64), "b": np.array(found[1], np.int64)})

    rows = vectors.select("label", "dim", "id", "v", "passes").mapInArrow(keyed, _ROW)
    n = max(partitions(vectors.sparkSession), 1)
    order = ["pass", "label", "dim", "key", "id"]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = stored(ranged.mapInArrow(compared, "a bigint, b bigint, edge bigint, place string, v binary"), "neardup-passes")
    at_edges = made.filter("edge is not null").groupBy("edge").applyInPandas(across, "a bigint, b bigint")
    return made.filter("edge is null").select("a", "b").unionByName(at_edges).distinct()


def _linked_rows(ids: np.ndarray, v: np.ndarray, threshold: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, id) of a tree over each set of vectors connected by links of the ``first`` ones."""
    a, b = np.nonzero(v[:first] @ v.T >= threshold)
    root = _joined(np.arange(len(ids)), a, b)
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def link_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links): copies of other vectors linked to each; ``members`` has component, id, copies, v.

    A component is cut into blocks by a hash of the id. Each pair of blocks is one group, so that a
    vector travels once per block; components of one block share groups.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("_size"))
    cut = members.join(sizes, "component").withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    n = 4 * partitions(members.sparkSession)
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    cut = cut.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    group = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(n))).otherwise(
        F.xxhash64("component", F.least("_own", "_other"), F.greatest("_own", "_other"))
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, links = [], []
        for (_, lo, hi), rows in pdf.groupby(["component", "_lo", "_hi"]):
            v, copies, own = np.array(rows.v.tolist()), rows.copies.to_numpy(), rows._own.to_numpy()
            near = v @ v.T >= threshold
            np.fill_diagonal(near, False)
            if lo != hi:
                near &= own[:, None] != own[None, :]
            ids.extend(rows.id)
            links.extend(near @ copies)
        return pd.DataFrame({"id": np.array(ids, np.int64), "links": np.array(links, np.int64)})

    keyed = cut.select("component", "id", "copies", "v", "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), group.alias("_group"))
    return keyed.groupBy("_group").applyInPandas(count, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def linked(heads: DataFrame, threshold: float, window: int) -> DataFrame:
    """(a, b): trees over linked vectors, by passes or, where these compare no fewer pairs, by all pairs of a label."""
    measured = stored(sides_measured(heads, window), "neardup-sides")
    need = {s: passes_of_sides(s, threshold) for s in range(SIDES + 1)}
    costs = F.create_map(*[x for s, p in need.items() for x in (F.lit(s), F.lit(int(min(p, 1 << 30))))])
    measured = measured.withColumn("passes", costs[F.col("sides")])
    measured = measured.withColumn("passes", F.when(F.col("passes").cast("long") * (2 * window) < F.col("n"), F.col("passes")).otherwise(0))
    small = measured.count() <= BROADCAST_LABELS
    rows = heads.join(F.broadcast(measured) if small else measured, ["label", "dim"]).select("label", "dim", "id", "v", "n", "passes")
    met = met_in_blocks(rows.filter("passes = 0"), threshold)
    if measured.filter("passes > 0").limit(1).count():
        met = met.unionByName(met_in_passes(rows.filter("passes > 0"), threshold, window)).distinct()
    return met


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, window: int = WINDOW
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared if their labels are equal and not null and they have as many components.
    Null, empty and zero vectors and those with a null or non-finite component link with nothing, as
    does a row without an id. Rows that repeat an id are vectors of their own under one id. An empty
    table gives an empty result.
    """
    base = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & whole, F.lit(False))
    base = base.withColumn("good", good).withColumn("dim", F.size("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    same = ["label", "dim", "h1", "h2"]
    heads = base.filter("good").groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def unit(batches):
        for b in batches:
            lists = b.column(6)
            out = np.empty(len(lists.flatten()))
            off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for at, v in _by_dim(lists):
                v = v / np.abs(v).max(axis=1, keepdims=True)
                out[off[at][:, None] + np.arange(v.shape[1])] = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            made = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), made], b.schema.names)

    heads = heads.select(*same, "id", "copies", "v")
    heads = stored(heads.mapInArrow(unit, heads.schema), "neardup-heads")
    links = linked(heads, threshold, window)
    found = components(links)
    members = heads.select("id", "copies", "v").join(found, "id")
    counts = link_counts(members, threshold)
    classes = heads.select(*same, "id", "copies").join(found, "id", "left").join(counts, "id", "left")
    classes = classes.select(
        *same, F.coalesce("component", "id").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links")
    )
    out = base.withColumn("label", F.when(F.col("good"), F.col("label"))).join(classes, same, "left")
    component = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
