"""A Merkle manifest of a dataset by time-forward processing.

Nodes are labelled by level and place, children before parents. A sweep over rising labels takes from
a priority queue all digests sent to the next label, makes that node and sends its digest on to its
parent. A second sweep over falling labels sends each node's proof suffix, the siblings from its own
level up, to its children, until leaves have whole proofs. The queue is external: the tree is cut into
blocks of 256 consecutive nodes, a block's sweep holds a queue of that many messages, and what leaves
a block waits in a stored table, which the shuffle hands to the block of its label. Each round climbs
two levels, so 10**11 leaves take five.

Leaves are ordered by ranges and blocks are groups of neighbours, so a source of any size is spread.
Texts are hashed where they are read; only digests travel.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Sequence
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spreadlake.llm.common import stored
from spreadlake.llm.order import in_order, key_of, within

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Children of a node, and levels that one round climbs.
FAN, LEVELS = 16, 2

BLOCK = FAN**LEVELS

NODES = "_key string, _index bigint, _n bigint, digest string"
CARRIED = ("proof", "subroot", "root")


def digest_of(*inputs: Column) -> Column:
    """Lower-case hexadecimal sha256 of the inputs' concatenation; a null input is ``-``, others are length, colon, value."""

    def spelled(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.encode(F.concat(*map(spelled, inputs)), "utf-8"), 256)


def climbs(n: int) -> int:
    """Levels that a round adds to a tree of which ``n`` nodes remain."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def forward(digests: Sequence[str], first: int, levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """(digest of the block's top, digests that reached each label); ``first`` is the place of the first one."""
    if not levels:
        return digests[0], {}
    queue = [(1, (first + i) // FAN, i, d) for i, d in enumerate(digests)]
    heapq.heapify(queue)
    arrived: dict[tuple[int, int], list[str]] = {}
    while True:
        level, place, slot, d = heapq.heappop(queue)
        arrived.setdefault((level, place), []).append(d)
        if queue and queue[0][:2] == (level, place):
            continue
        made = sha256("".join(arrived[level, place]).encode()).hexdigest()
        if level == levels:
            return made, arrived
        heapq.heappush(queue, (level + 1, place // FAN, place, made))


def backward(arrived: dict[tuple[int, int], list[str]], first: int, count: int, levels: int, suffix: list[str]) -> list[list[str]]:
    """Proofs of the block's nodes: pairs of what stands left and right of them, level by level, then the suffix."""
    out: list[list[str]] = [suffix] * count
    queue = [(-levels, first // FAN**levels, suffix)] if levels else []
    while queue:
        level, place, above = heapq.heappop(queue)
        children = arrived[-level, place]
        left = list(accumulate(children, initial=""))
        right = list(accumulate(reversed(children), lambda a, b: b + a, initial=""))[::-1]
        for i in range(len(children)):
            own = [left[i], right[i + 1], *above]
            child = (place * FAN if -level > 1 else max(place * FAN, first)) + i
            if level == -1:
                out[child - first] = own
            else:
                heapq.heappush(queue, (level + 1, child, own))
    return out


def climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes of each round, stored; the last round's are the roots, one per key."""
    rounds = [nodes]

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("_index")
        first, n = group.column("_index")[0].as_py(), group.column("_n")[0].as_py()
        top, _ = forward(group.column("digest").to_pylist(), first, climbs(n))
        return pa.table({
            "_key": group.column("_key").slice(0, 1), "_index": pa.array([first // BLOCK], pa.int64()),
            "_n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array([top]),
        })

    while (rounds[-1].agg(F.max("_n")).first()[0] or 0) > 1:
        last = rounds[-1]
        grown = last.filter("_n > 1").select("_key", "_index", "_n", "digest").groupBy("_key", F.expr(f"_index div {BLOCK}").alias("_block")).applyInArrow(work, NODES)
        rounds.append(stored(grown.unionByName(last.filter("_n = 1").select("_key", "_index", "_n", "digest")), f"{label}-{len(rounds)}"))
    return rounds


def _proving(kept: list[str], given: pa.Schema):
    """What proves the nodes of a block, given the proof of its top."""

    def work(group: pa.Table, above: pa.Table) -> pa.Table:
        if not group.num_rows:
            return given.empty_table()
        group = group.sort_by("_index")
        count, first, n = group.num_rows, group.column("_index")[0].as_py(), group.column("_n")[0].as_py()
        _, arrived = forward(group.column("digest").to_pylist(), first, climbs(n))
        proofs = backward(arrived, first, count, climbs(n), above.column("proof")[0].as_py())
        same = [pa.array([above.column(c)[0].as_py()] * count, pa.string()) for c in ("subroot", "root")]
        columns = [*(group.column(c) for c in kept), pa.array(proofs, pa.list_(pa.string())), *same]
        return pa.Table.from_arrays(columns, names=given.names).cast(given)

    return work


def descend(rounds: list[DataFrame], tops: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(_key, _index, proof, subroot, root) of the first round's nodes, beside what is kept of them; ``tops`` has the roots'."""
    if len(rounds) == 1:
        return rounds[0].select("_key", "_index", *keep).join(tops.select("_key", *CARRIED), "_key")
    proved = tops
    for k in range(len(rounds) - 2, -1, -1):
        kept = ["_key", "_index", *(keep if k == 0 else ())]
        nodes = rounds[k].select(*dict.fromkeys(["_n", "digest", *kept]))
        schema = T.StructType([*nodes.select(*kept).schema.fields, *tops.select(*CARRIED).schema.fields])
        given = pa.schema([*to_arrow_schema(nodes.select(*kept).schema), *to_arrow_schema(tops.select(*CARRIED).schema)])

        block = F.expr(f"_index div {BLOCK}").alias("_block")
        above = proved.select("_key", F.col("_index").alias("_block"), *CARRIED)
        many = nodes.filter("_n > 1").select("*", block).groupBy("_key", "_block").cogroup(above.groupBy("_key", "_block"))
        single = nodes.filter("_n = 1").select(*kept).join(proved.select("_key", *CARRIED), "_key")
        proved = many.applyInArrow(_proving(kept, given), schema).unionByName(single)
        if k:
            proved = stored(proved, f"{label}-{k}")
    return proved


def manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """(doc_id, leaf, tampered_leaf, subroot, root, proof) per row.

    A leaf is the digest of a row's ``fields``. Per source (null is one, and the first) leaves ascend
    by id, null first, rows of one id by their leaves. ``proof`` holds for each level from the leaf up
    to the root the digests left of the node and those right of it. ``tampered`` gives other values to
    some fields of the rows that ``where`` holds for; ``tampered_leaf`` is the leaf of those, null
    elsewhere. Null fields, empty and long texts and repeated rows are leaves like any other, other
    columns are not carried, a table of one row has its leaf as root and an empty proof, and an empty
    table gives an empty result.
    """
    changed = digest_of(*[(tampered or {}).get(c, F.col(c)) for c in fields])
    leaves = docs.select(
        key_of(source).alias("_key"), F.col(doc_id).alias("doc_id"), digest_of(*map(F.col, fields)).alias("digest"),
        F.when(F.lit(False) if where is None else where, changed).alias("tampered_leaf"),
    )
    order = [F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    leaves = in_order(leaves, order, "manifest-leaves")
    rounds = climb(stored(within(leaves).drop("_at").withColumn("leaf", F.col("digest")), "manifest-placed"), "manifest-round")
    subroots = rounds[-1].select(F.lit("").alias("_key"), F.col("_key").alias("_source"), "digest")
    subroots = stored(within(in_order(subroots, [F.col("_source")], "manifest-sources")).drop("_at"), "manifest-subroots")
    upper = climb(subroots, "manifest-upper")
    none = F.array().cast("array<string>")
    top = upper[-1].select("_key", "_index", none.alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    of_source = descend(upper, top, "manifest-proofs", ("_source", "digest"))
    tops = of_source.select(
        F.col("_source").alias("_key"), F.lit(0).cast("bigint").alias("_index"), "proof", F.col("digest").alias("subroot"), "root"
    )
    found = ("doc_id", "leaf", "tampered_leaf")
    return descend(rounds, stored(tops, "manifest-tops"), "manifest-down", found).select(*found, "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    steps = F.sequence(F.lit(1), F.size(proof), F.lit(2))
    steps = F.when(F.size(proof) > 0, steps).otherwise(F.array().cast("array<int>"))

    def climbed(node: Column, i: Column) -> Column:
        return F.sha2(F.encode(F.concat(F.element_at(proof, i), node, F.element_at(proof, i + 1)), "utf-8"), 256)

    return F.aggregate(steps, leaf, climbed)
