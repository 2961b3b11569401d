"""Conversation repair against a plain version, and its edge cases."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F, types as T

from spreadlake.llm.dialogue import BEGIN, LAST, STATES, digests, repair, step, table_of, walks

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("_key", T.StringType()), T.StructField("edit", T.IntegerType()),
])
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def hurt(rows):
    """The rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text, *_ in sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, (" " if r[2] is None else r[2]).encode(), (" " if r[3] is None else r[3]).encode())
    ):
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    rows, seen, faults = hurt(rows), set(), []
    for _, role, text in rows:
        said = re.sub(r"[^\x20\x09-\x0D]", "x", text).strip(" \t\n\x0b\x0c\r")
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if last not in (".", "!", "?") else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state):
        """(cost, audit) by trying all edits; insertions are bounded as three in a row lead anywhere."""
        return min(after_inserts(i, s, e, c) for s, e, c in inserted(state))

    def inserted(state):
        out, e, c = [(state, "", 0)], "", 0
        for _ in range(3):
            state, e, c = NEXT[state], e + "I", c + 3
            out.append((state, e, c))
        return out

    def after_inserts(i, state, edits, cost):
        if i == len(rows):
            return (cost, edits) if state in ("", "a") else (10**9, "")
        fault, first = faults[i], rows[i][1][:1]
        moves = [("D", state, 4)]
        if fault in ("", "truncated"):
            more = 3 if fault else 0
            moves.append(("R", NEXT[state], 3 + more))
            if first and (first == NEXT[state] or first == "s" and state == ""):
                moves.append(("K", first, more))
        return min((cost + c + best(i + 1, to)[0], edits + m + best(i + 1, to)[1]) for m, to, c in moves)

    cost, audit = best(0, "")
    lines, i, due = [], 0, "user"
    for m in audit:
        role, text = rows[i][1:] if m != "I" else (None, "")
        i += m != "I"
        if m == "D":
            continue
        if m in "IR":
            role = due
        lines.append(f"{role}:{text}")
        due = due if role[:1] == "s" else "assistant" if due == "user" else "user"
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, rows):
    lines, found = repair(spark.createDataFrame(rows, SCHEMA))
    got = found.join(digests(lines), "_key", "left").collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert len(got) == len(by)
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        have = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256 or empty)
        assert have == plain(by[r.conv_id]), r.conv_id


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "  ", None, "", "Why? ", "Because!\n", "é.", "Yes.", "a . b"]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "usher"]
    rows = []
    for conv in [None, *range(120)]:
        for k in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([None, k, k, k, k + 2, 3]), rng.choice(roles), rng.choice(texts), "x", 1))
    compare(spark, rows)


def test_one_long_conversation_and_many_copies(spark):
    rng = random.Random(6)
    sys.setrecursionlimit(20_000)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), f"t{k}" + rng.choice([".", "", "!"]), "x", 1) for k in range(900)]
    rows += [(2, 5, "user", "Same.", "x", 1)] * 300 + [(2, k, "assistant", "Same.", "x", 1) for k in range(20)]
    rows += [(3, 0, "user", "word " * 100_000 + ".", None, None), (3, 1, "assistant", "ok.", None, None)]
    compare(spark, rows)


def test_a_conversation_that_damage_leaves_empty_and_none_at_all(spark):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    compare(spark, [(gone, 0, "user", "Hi.", None, 1)])
    lines, found = repair(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and lines.count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_blocks_chain_to_the_whole(seed):
    rng = random.Random(seed)
    kinds = "".join(chr(97 + rng.randrange(16)) for _ in range(rng.randint(2, 60)))
    vector = list(LAST)
    for k in reversed(kinds):
        vector = step(k, vector)
    cut = rng.randrange(1, len(kinds))
    behind = list(LAST)
    for k in reversed(kinds[cut:]):
        behind = step(k, behind)
    table = table_of(kinds[:cut])
    assert vector == [min(table[4 * s + t] + behind[t] for t in STATES) for s in STATES]
    whole = walks(kinds, LAST, True)[BEGIN][1]
    state, first = walks(kinds[:cut], tuple(behind), False)[BEGIN]
    assert first + walks(kinds[cut:], LAST, True)[state][1] == whole


def test_rows_of_the_repair(spark):
    rows = [(1, 1, "assistant", "So.", None, None), (1, 2, "user", "Well?", None, None)]
    lines, found = repair(spark.createDataFrame(rows, SCHEMA))
    audit = found.first()["audit"]
    said = [(r.edit, r.role[:1]) for r in lines.orderBy("_index", "_slot").collect()]
    assert [e for e, _ in said] == [c for c in audit if c != "D"]
    assert re.fullmatch("(s?(ua)+)?", "".join(r for _, r in said))
    assert set(lines.filter(F.col("edit") == "I").select("text").distinct().toPandas()["text"]) <= {""}
