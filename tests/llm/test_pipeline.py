"""The pipeline against plain versions of its stages, on a small corpus with planted cases."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from spreadlake.llm import mixing, quality  # noqa: E402
from spreadlake.llm.common import crc_mod, stored  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _row string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    syllables = ["ka", "lo", "mi", "Ta", "re", "són", "na", "pi", "du"]

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    texts, good = [], []
    for i in range(400):
        t = prose(rng.randint(40, 120))
        bad = i % 6 == 5
        texts.append([" | ".join(t.split()), t.upper().replace(" ", "!! "), " ".join([t.split()[0]] * 80), t.replace(" ", "### ")][i % 4] if bad else t)
        good.append(int(not bad))
    passage = prose(60)
    clean = [i for i in range(400) if good[i]]
    for a, b in zip(clean[:40:2], clean[1:40:2]):
        texts[b] = texts[a] if a % 3 else texts[a] + " end"
    for i in clean[50:60]:
        texts[i] = prose(40) + " " + passage + " " + prose(40)
    texts += [None, "", "one", "one"]
    good += [0, 0, 1, 1]
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", ["a", "a", "b", None][i % 4], None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_do_what_plain_versions_do(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, corpus), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        results.append(out)
        docs = out
    raw = {r.doc_id: r for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    kept, single, cut, mixed, packed = ([r.asDict() for r in x.collect()] for x in results)

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    weights = quality.learn(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    good = {r.doc_id for r in quality.score(spark.read.parquet(f"{corpus}/documents.parquet"), weights).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept} == good and all(r["text"] == raw[r["doc_id"]].text for r in kept)
    judged = [(i, q) for i, q in labels.items() if raw[i].text and len(brute.words(raw[i].text)) > 20]
    assert np.mean([(i in good) == q for i, q in judged]) > 0.95

    near = brute.near_duplicates([(r["doc_id"], r["text"]) for r in kept])
    assert {r["doc_id"] for r in single} == {i for i, (_, c) in near.items() if c == i} and len(single) < len(kept)

    left = brute.without_repeats([(r["doc_id"], r["text"]) for r in single])
    shortened = 0
    for r in cut:
        before = raw[r["doc_id"]].text
        if left[r["doc_id"]] == brute.words(before):
            assert r["text"] == before
        else:
            shortened += 1
            assert r["text"] == b" ".join(left[r["doc_id"]]).decode() and r["n_chars"] == len(r["text"])
    assert shortened and len(cut) == len(single)

    sizes = {}
    for r in cut:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = brute.water_filled(sizes, (3, 1, 2), 1.5, 2.0)
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for r in cut:
        rate = want[r["source"]] / sizes[r["source"]]
        assert times.get(r["doc_id"], 0) in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    assert mixing.TURNS > 1

    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r["piece"])
    assert set(pieces) == set(times) and all(len(p) == times[i] * (max(p) + 1) for i, p in pieces.items())
    sequences = {}
    for r in packed:
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], 0) + r["length"]
    assert max(sequences.values()) <= 2048 and len(sequences) == -(-sum(sequences.values()) // 2048)

    again = [r.asDict() for r in entry.queries()["pipeline"](spark, corpus).collect()]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_stages_take_odd_and_empty_tables(spark, corpus):
    rows = [(None, "a b", "en", None, 3, "x", "y"), (7, "same words here", None, "s", 15, "x", "y"), (7, "same words here", None, "s", 15, "x", "y"), (8, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), corpus).count() == 0
    pieces = corpus_pipeline.best_fit_packing(spark, odd, corpus).collect()
    assert sorted(r.doc_id or 0 for r in pieces) == [0, 7, 7, 8]
    mixed = corpus_pipeline.source_mixing(spark, odd, corpus).collect()
    # every source takes 1.5 times its words: a copy at least, two at most
    assert {(r.doc_id, r.text) for r in mixed} >= {(None, "a b"), (7, "same words here")} and len(mixed) <= 8
    same = spark.createDataFrame([(5, "one text of its own", "en", "s", 19, "x", "y"), (5, "quite another", "en", "s", 13, "x", "y"), (5, "quite another", "en", "r", 13, "x", "y")], SCHEMA)
    kept = corpus_pipeline.ngram_jaccard_join(spark, same, corpus).collect()
    assert sorted((r.text, r.source) for r in kept) == [("one text of its own", "s"), ("quite another", "r")]
    near = corpus_pipeline.ngram_jaccard_join(spark, odd, corpus)
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 7, 8]
    cut = corpus_pipeline.substring_dedup(spark, odd, corpus)
    assert sorted(map(str, (r.text for r in cut.collect()))) == sorted(map(str, (r[1] for r in rows)))


def test_queries_of_every_operator_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_mixing_keeps_columns_of_any_name_and_rows_without_an_id(spark):
    from spreadlake.llm.mixing import emit_copies, mix_sources

    rows = [(None, "a b c", "s", 1, "t", 0.5, 9), (3, "d e", "s", 2, "u", 0.25, 8), (None, None, None, 3, "v", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, turn int, _source string, draw double, weight int")
    mixed = mix_sources(docs)
    got = {r.turn: r for r in mixed.collect()}
    assert mixed.columns[:7] == ["doc_id", "text", "source", "turn", "_source", "draw", "weight"] and got[1].weight == 9
    assert [got[t]._source for t in (1, 2, 3)] == ["t", "u", "v"]
    assert all(r.copies is not None for r in got.values()) and got[1].copies >= 1
    assert emit_copies(mixed, ["text"]).filter("text = 'a b c'").count() == got[1].copies


def test_run_keeps_one_stored_stage(spark, corpus, monkeypatch):
    held = []

    def noted(df, label):
        held.append(stored(df, label))
        return held[-1]

    plain = lambda s, docs, d: docs
    monkeypatch.setattr(corpus_pipeline, "stored", noted)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage {k}", plain) for k in range(4)])
    assert corpus_pipeline.run(spark, corpus).count() == 404
    folders = [f.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for f in held]
    assert [os.path.exists(x) for x in folders] == [False, False, True]
