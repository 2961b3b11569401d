"""The Merkle manifest against a plain version, and its edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from spreadlake.llm.manifest import FAN, backward, climbs, folded, forward, manifest

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("digest", T.StringType()),
    T.StructField("_index", T.LongType()), T.StructField("root", T.StringType()),
])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def plain(nodes):
    """(root, proofs) level by level."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            proofs[k] += "".join(nodes[run:i]) + "".join(nodes[i + 1 : run + 16])
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], proofs


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        leaves = [x[2] for x in sorted((r[0] is not None, r[0] or 0, leaf(r)) for r in by[s])]
        made[s] = (leaves, *plain(leaves))
    root, upper = plain([made[s][1] for s in order])
    return sorted((x, made[s][1], root, h(p + u)) for s, u in zip(order, upper) for x, p in zip(made[s][0], made[s][2]))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 600])
def test_block_sweeps(n):
    digests = [h(str(i)) for i in range(n)][:256]
    levels = climbs(n)
    top, arrived = forward(digests, 0, levels)
    for d, proof in zip(digests, backward(arrived, 0, len(digests), levels, ["x", "y"])):
        for i in range(0, len(proof) - 2, 2):
            d = h(proof[i], d, proof[i + 1])
        assert d == top and proof[-2:] == ["x", "y"]


def test_matches_the_plain_version(spark):
    rows = [(i, f"Text {i}", "en", "hot", 5, "d", 1, "r") for i in range(5000)]
    rows += [(i, None, None, f"s{i % 20}", None, None, None, None) for i in range(0, 600, 3)]
    rows += [(None, "ü" * i, "de", None, i, "x", 2, "y") for i in range(20)] + [(7, "same", "en", "é", 4, "", 0, "")] * 3
    got = manifest(spark.createDataFrame(rows, SCHEMA))
    got = got.withColumn("p", F.sha2(F.array_join("proof", "").cast("binary"), 256)).withColumn("f", folded(F.col("leaf"), F.col("proof")))
    got = got.select("leaf", "subroot", "root", "p", "f").collect()
    assert sorted((r.leaf, r.subroot, r.root, r.p) for r in got) == expected(rows)
    assert all(r.f == r.root for r in got)


def test_tampering_shows(spark):
    rows = [(i, t, "en", "s", 1, "", 0, "") for i, t in enumerate(["Abc", "abc", None, "", "X y"])]
    lower = {"text": F.lower("text")}
    got = manifest(spark.createDataFrame(rows, SCHEMA), tampered=lower, where=F.col("doc_id") != 4)
    got = {r.doc_id: r for r in got.withColumn("f", folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))).collect()}
    assert [got[i].f == got[i].root for i in range(5)] == [False, True, True, True, True]
    assert got[4].tampered_leaf is None


def test_one_row_and_none(spark):
    one = manifest(spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == h("-----") and one[0].proof == []
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fan_is_the_contracts():
    assert FAN == 16
