"""Repair of damaged conversations: the cheapest edits that make roles alternate, by a checkpointed dynamic program.

A state is what the repaired roles end in: nothing, a system row, a user row or an assistant row. The
state-cost vector of a place says what the rest of the conversation costs from each state. Vectors are
kept only at checkpoints, the square root of its rows apart; a block between two checkpoints computes
its own again while it walks forward and emits at each place the least letter of those whose cost is tight.

Blocks are rows of their own, so a conversation of any length is spread: each block first gives the
cost from every state in front of it to every state behind it, these square-root-many small tables
are folded backward into the vectors at the checkpoints, every block then walks from each of the four
states it may be entered in, and one more pass over the blocks' exits says which walk counts.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm.common import partitions, slices, stored
from spreadlake.llm.order import in_order, key_of, within

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What the repaired roles may end in; a conversation may end in the first or the last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)

STATES = range(4)

#: Cost of a deletion, of another role, of an insertion and of keeping a truncated row.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

#: First faults of a row, and initials of a role that may stand in a conversation; 3 is any other.
FINE, CUT_OFF, BLANK, REPEATED = range(4)
INITIALS = "sua"

_FAR = 1 << 40
_BLANKS = " \t\n\x0b\x0c\r"

CHECKPOINTS = """_key string, cost bigint, illegal bigint, after array<array<bigint>>"""


def turn_after(state: int) -> int:
    """The state behind a user or assistant row: whichever is due."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state behind a kept row, none if it may not stand there."""
    if initial == 0:
        return SYSTEM if state == BEGIN else None
    due = turn_after(state)
    return due if initial == (1 if due == USER else 2) else None


def closed(vector: list[int]) -> list[int]:
    """The vector of a place from that behind its insertions; three in a row lead to every state that any number leads to."""
    out = []
    for s in STATES:
        best, cost = vector[s], 0
        for _ in range(3):
            s, cost = turn_after(s), cost + INSERT
            best = min(best, cost + vector[s])
        out.append(best)
    return out


#: The vector behind the last row: what insertions it still takes to end in nothing or an assistant row.
LAST = tuple(closed([0, _FAR, _FAR, 0]))


def step(kind: str, behind: list[int]) -> list[int]:
    """The vector in front of a row from that behind it. ``kind`` is a letter: four times the initial and the fault."""
    initial, fault = divmod(ord(kind) - 97, 4)
    out = []
    for s in STATES:
        cost = DELETE + behind[s]
        if fault in (FINE, CUT_OFF):
            more = TRUNCATED if fault == CUT_OFF else 0
            cost = min(cost, REROLE + more + behind[turn_after(s)])
            to = kept(s, initial)
            if to is not None:
                cost = min(cost, more + behind[to])
        out.append(cost)
    return closed(out)


@lru_cache(100_000)
def table_of(kinds: str) -> tuple[int, ...]:
    """Costs from each state in front of a block (rows) to each behind it (columns), row by row."""
    columns = []
    for to in STATES:
        vector = [0 if s == to else _FAR for s in STATES]
        for kind in reversed(kinds):
            vector = step(kind, vector)
        columns.append(vector)
    return tuple(min(columns[to][s], _FAR) for s in STATES for to in STATES)


@lru_cache(100_000)
def walks(kinds: str, behind: tuple[int, ...], last: bool) -> tuple[tuple[int, str], ...]:
    """For each state in front of a block: the state behind it and the least tight edits.

    Letters are K, D, R and I; R and I are small where they make an assistant row.
    """
    vectors = [list(behind)]
    for kind in reversed(kinds):
        vectors.append(step(kind, vectors[-1]))
    vectors.reverse()
    out = []
    for state in STATES:
        edits: list[str] = []
        at = 0
        while True:
            cost = vectors[at][state]
            if at == len(kinds) and (not last or cost == 0):
                break
            due = turn_after(state)
            tight = [("I", at, due, INSERT, due)]
            if at < len(kinds):
                initial, fault = divmod(ord(kinds[at]) - 97, 4)
                tight.append(("D", at + 1, state, DELETE, None))
                if fault in (FINE, CUT_OFF):
                    more = TRUNCATED if fault == CUT_OFF else 0
                    to = kept(state, initial)
                    if to is not None:
                        tight.append(("K", at + 1, to, more, None))
                    tight.append(("R", at + 1, due, REROLE + more, due))
            letter, at, state, _, role = min((e for e in tight if e[3] + vectors[e[1]][e[2]] == cost), key=lambda e: e[0])
            edits.append(letter.lower() if role == ASSISTANT else letter)
        out.append((state, "".join(edits)))
    return tuple(out)


def illegal_pairs(kinds: str) -> int:
    """Neighbours whose initials are neither system and user nor user and assistant in turn."""
    initials = [(ord(k) - 97) // 4 for k in kinds]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def damaged(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) rows after seeded damage by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row, 1 empties its text, 2 takes its marks of sentence ends, 3 repeats it and 4 makes
    its role user. Columns ``_key``, ``_at`` and ``_index`` give the place: by turn, null first, then by
    role and text as they were before.
    """
    fault = F.crc32(F.encode(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)]), "utf-8")) % 20
    rows = convs.select(
        key_of(conv_id).alias("_key"), F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), fault.alias("_fault"),
    ).filter("_fault <> 0")

    def change(df: DataFrame) -> DataFrame:
        twice = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
        hurt = df.withColumn("_copy", twice).select("_key", "conv_id", "turn", role.alias("role"), text.alias("text"))
        return looked_at(hurt)

    order = [F.col("_key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return in_order(rows, order, "dialogue-damaged", change)


def looked_at(rows: DataFrame) -> DataFrame:
    """``rows`` with what later steps need to know of their texts: a digest of role and text, a first fault but for repeats, an initial."""
    # the trailing white space goes first, so a text is read once whatever it ends in
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    said = F.unhex(F.sha2(F.encode(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"), "utf-8"), 256))
    letter = F.left("role", F.lit(1))
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return rows.withColumn("_said", said).withColumn("_fault", fault).withColumn("_initial", initial)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of square-root-many rows of a conversation: their kinds and numbers in order, and counts of first faults."""
    light = rows.select("_key", "conv_id", "_at", "_said", "_fault", "_initial")
    firsts = light.groupBy("_key", "_said").agg(F.min("_at").alias("_first"), F.count("*").alias("_times")).filter("_times > 1")
    seen = within(light).join(firsts.drop("_times"), ["_key", "_said"], "left")
    fault = F.when((F.col("_fault") != BLANK) & (F.col("_at") > F.col("_first")), REPEATED).otherwise(F.col("_fault"))
    seen = seen.withColumn("_fault", fault).withColumn("_block", F.floor(F.col("_index") / F.ceil(F.sqrt("_n"))))
    kind = F.char(97 + 4 * F.col("_initial") + F.col("_fault"))
    grouped = seen.groupBy("_key", "_block").agg(
        F.first("conv_id").alias("conv_id"), F.min("_index").alias("_start"), F.max("_n").alias("_n"),
        *[F.sum((F.col("_fault") == f).cast("bigint")).alias(n) for n, f in (("blank", BLANK), ("duplicate", REPEATED), ("truncated", CUT_OFF))],
        F.array_sort(F.collect_list(F.struct("_index", "_at", kind.alias("_kind")))).alias("_rows"),
    )
    return grouped.select(
        "_key", "_block", "conv_id", "_start", "blank", "duplicate", "truncated",
        F.array_join(F.col("_rows._kind"), "").alias("_kinds"), F.col("_rows._at").alias("_ats"),
        (F.col("_start") + F.size("_rows") == F.col("_n")).alias("_last"),
    )


def checkpoints(blocks: DataFrame) -> DataFrame:
    """Per conversation the cheapest cost, the illegal neighbours and the vector behind each block."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(table_of, kinds), pa.list_(pa.int64())), pa.array(map(illegal_pairs, kinds), pa.int64()),
                 pa.array([k[0] for k in kinds]), pa.array([k[-1] for k in kinds])],
                ["_key", "_block", "_table", "_illegal", "_head", "_tail"],
            )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost, illegal, after = [], [], []
            for parts in b.column(1).to_pylist():
                vector, vectors = list(LAST), []
                for p in reversed(parts):
                    vectors.append(vector)
                    t = p["_table"]
                    vector = [min(t[4 * s + to] + vector[to] for to in STATES) for s in STATES]
                cost.append(vector[BEGIN])
                seams = sum(illegal_pairs(x["_tail"] + y["_head"]) for x, y in zip(parts, parts[1:]))
                illegal.append(seams + sum(p["_illegal"] for p in parts))
                after.append(vectors[::-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(after, pa.list_(pa.list_(pa.int64())))],
                ["_key", "cost", "illegal", "after"],
            )

    shape = "_key string, _block bigint, _table array<bigint>, _illegal bigint, _head string, _tail string"
    costs = blocks.select("_key", "_block", "_kinds").mapInArrow(tables, shape)
    parts = F.array_sort(F.collect_list(F.struct("_block", "_table", "_illegal", "_head", "_tail")))
    return costs.groupBy("_key").agg(parts.alias("_parts")).mapInArrow(fold, CHECKPOINTS)


def edited(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """``blocks`` with their ``edits``, a unit per row: insertions in front of it and its own letter; the last may be insertions only."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, behind, last = (b.column(i).to_pylist() for i in (2, 3, 4))
            found = [walks(k, tuple(v), e) for k, v, e in zip(kinds, behind, last)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int32())),
                 pa.array([[e for _, e in f] for f in found], pa.list_(pa.string()))],
                ["_key", "_block", "_exits", "_edits"],
            )

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entered = []
            for parts in b.column(1).to_pylist():
                state, states = BEGIN, []
                for p in parts:
                    states.append(state)
                    state = p["_exits"][state]
                entered.append(states)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(entered, pa.list_(pa.int32()))], ["_key", "_entered"])

    behind = ends.select("_key", F.posexplode("after").alias("_block", "_behind"))
    known = blocks.join(behind.withColumn("_block", F.col("_block").cast("bigint")), ["_key", "_block"])
    shape = "_key string, _block bigint, _exits array<int>, _edits array<string>"
    walked = stored(known.select("_key", "_block", "_kinds", "_behind", "_last").mapInArrow(walk, shape), "dialogue-walks")
    exits = walked.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_block", "_exits"))).alias("_parts"))
    entered = exits.mapInArrow(enter, "_key string, _entered array<int>").select("_key", F.posexplode("_entered").alias("_block", "_state"))
    chosen = walked.join(entered.withColumn("_block", F.col("_block").cast("bigint")), ["_key", "_block"])
    edits = F.element_at("_edits", F.col("_state") + 1).alias("edits")
    return blocks.join(chosen.select("_key", "_block", edits), ["_key", "_block"])


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text) of the repaired conversations; ``_key``, ``_index`` and ``_slot`` order them.

    An inserted row's text is empty. Rows meet their edits by their number, whatever conversation they are of.
    """
    units = edits.select("_key", "conv_id", "_start", "_ats", F.posexplode(F.regexp_extract_all("edits", F.lit("[Ii]*[KDRr]|[Ii]+$"), F.lit(0))).alias("_nth", "_unit"))
    units = units.select("_key", "conv_id", (F.col("_start") + F.col("_nth")).alias("_index"), F.get("_ats", F.col("_nth")).alias("_at"), "_unit")
    units = units.filter("_unit <> 'D'").join(rows.select("_at", "role", "text"), "_at", "left")
    lines = units.select("_key", "conv_id", "_index", F.posexplode(F.split("_unit", "")).alias("_slot", "edit"), "role", "text").filter("edit not in ('D', '')")
    made = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("i", "r"), "assistant").otherwise(F.col("role"))
    said = F.when(F.upper("edit") == "I", "").otherwise(F.col("text"))
    return lines.select("_key", "_index", "_slot", "conv_id", F.upper("edit").alias("edit"), made.alias("role"), said.alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """(_key, repaired_sha256) of each conversation's ``role:text`` lines. A task reads its conversations in order and holds no more than a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(names: list[str], sums: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string())], ["_key", "repaired_sha256"])

        key, running = None, None
        for part in slices(batches, 1):
            names, sums = [], []
            for k, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if k != key:
                    if running is not None:
                        names.append(key)
                        sums.append(running.hexdigest())
                    key, running = k, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(line.encode())
            yield made(names, sums)
        if running is not None:
            yield made([key], [running.hexdigest()])

    ordered = lines.repartition(partitions(lines.sparkSession), "_key").sortWithinPartitions("_key", "_index", "_slot")
    return ordered.select("_key", F.concat("role", F.lit(":"), "text").alias("_line")).mapInArrow(work, "_key string, repaired_sha256 string")


def repair(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(damaged conversations' repaired rows, one row of findings per conversation of ``convs``).

    Findings: gaps in turns, first faults (blank, duplicate, truncated), illegal neighbours, least cost
    and the audit, the initials of the edits. A conversation without a row after damage has zeros and
    an empty audit. Null ids are one conversation; a null turn comes first and is in no gap; rows that
    are alike are repeats of the first of them; other columns are not carried; an empty table gives
    empty results. An empty role has no initial and is never kept.
    """
    rows = damaged(convs.select("conv_id", "turn", "role", "text"))
    blocks = stored(blocks_of(rows), "dialogue-blocks")
    ends = stored(checkpoints(blocks), "dialogue-checkpoints")
    edits = stored(edited(blocks, ends), "dialogue-edits")
    letters = F.array_sort(F.collect_list(F.struct("_block", F.upper("edits").alias("edits"))))
    audits = edits.groupBy("_key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.array_join(letters["edits"], "").alias("audit")
    )
    turns = rows.groupBy("_key", "turn").agg(F.lit(1)).groupBy("_key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    keys = convs.groupBy(key_of("conv_id").alias("_key")).agg(F.first("conv_id").alias("conv_id"))
    found = keys.join(turns, "_key", "left").join(ends.drop("after"), "_key", "left").join(audits, "_key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return repaired(rows, edits), found.select("_key", "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"))
