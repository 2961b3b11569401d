"""Each operator on a table of odd rows against a plain version, and on an empty table."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from spreadlake.llm import fingerprint, graph, jaccard, langid, lm, mixing, neardup, packing, quality, sketch, substring, tokencount  # noqa: E402
from spreadlake.llm.common import WordHasher, crc_mod, forget, stored  # noqa: E402
import spreadlake.llm.common as common  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, keys int, component string, label string, _text int"
RNG = random.Random(5)
VOCABULARY = ["ka", "lo", "mi", "Ta", "re", "són", "über", "na", "pi", "qu", "du", "ve", "zo", "el", "ré"]


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """(id, text, lang, source): near and exact copies, shared passages, blanks, nulls, ties, one very long text."""
    base = [prose(RNG.randint(30, 140)) for _ in range(24)]
    passage = prose(60)
    texts = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2] + " one", "start " + base[3], base[4].replace(" ", "\n")]
    texts += [passage + " " + prose(20), prose(9) + " " + passage, passage, prose(5) + " " + passage + " " + passage]
    texts += [None, "", " \t\n", "one", "one", "two words", "TWO words", "four words are here", "x" * 5000, "日本 語 の 文", "a b c\x0bd"]
    texts += [prose(12_000), "la " * 400, "la " * 399 + "lo"]
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    return [(i, t, ["en", "fr", None][k % 3], ["s0", "s0", "s1", "é", None, ""][k % 6]) for k, (i, t) in enumerate(zip(ids, texts))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", 1, "z", "q", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, odd):
    return frame(spark, odd).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def table_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_are_hashed_alike_in_chunks_of_any_size(odd):
    column = pa.array([r[1] for r in odd])
    whole, counts = WordHasher().batch(column)
    said = [w for r in odd for w in brute.words(r[1])]
    assert counts.tolist() == [len(brute.words(r[1])) for r in odd]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(said, whole.tolist())) and len(set(seen.values())) == len(seen)
    was = common.CHUNK_BYTES
    try:
        for size in (5, 64, 1000):
            common.CHUNK_BYTES = size
            again, n = WordHasher().batch(column)
            assert (again == whole).all() and (n == counts).all()
    finally:
        common.CHUNK_BYTES = was


def test_op1_fingerprints(docs, none, odd, spark):
    got = table_of(fingerprint.fingerprint_edits(docs))
    order = sorted((i, t or "") for i, t, *_ in odd)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        if len(brute.words(t)) > 30 and len(set(brute.words(t))) > 10:
            assert r.near_edited > 0.3 > r.near_next or brute.words(after)[:3] == brute.words(t)[:3] or r.near_next < 0.9
    by_words = {}
    for i, t, *_ in odd:
        assert by_words.setdefault(tuple(brute.words(t)), got[i].fingerprint) == got[i].fingerprint
    assert len({f for w, f in by_words.items()}) == len(by_words)
    assert fingerprint.fingerprint_edits(none).count() == 0
    twice = frame(spark, [(1, "a b c d e f", None, None), (1, "a b", None, None), (2, "b c", None, None), (None, "x", None, None)])
    assert sorted(r.n_chars for r in fingerprint.fingerprint_edits(twice).collect()) == [3, 3, 11]
    assert fingerprint.fingerprint_edits(twice.filter("doc_id = 2")).first().near_next == 1


def test_op1_a_change_of_any_word_moves_an_anchor(spark):
    w = prose(40).split()
    rows = [(i, " ".join([*w[:i], "changed", *w[i + 1 :]]), None, None) for i in range(40)] + [(99, " ".join(w), None, None)]
    anchors = table_of(fingerprint.with_anchors(frame(spark, rows), "text", "a").select("doc_id", "a"))
    own = set(anchors.pop(99).a)
    for r in anchors.values():
        assert set(r.a) != own and len(set(r.a) & own) >= len(own) - 2 * fingerprint.K


def test_op2_targets_and_copies(docs, none, odd, spark):
    sizes = {}
    for _, t, _, s in odd:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.water_filled(sizes, (3, 1, 2), 1.5, 2.0)
    mixed = mixing.mix_sources(docs)
    got = mixed.collect()
    assert len(got) == len(odd) and set(docs.columns) - {"size"} <= set(mixed.columns)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.taken == r["size"] * r.copies <= 2 * r["size"]
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect())
    out = mixing.emit_copies(mixed, ["doc_id", "text"])
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(none).count() == 0
    full = mixing.mix_sources(docs, share=2.0)
    assert all(r.taken == 2 * r["size"] for r in full.collect())
    empty_texts = frame(spark, [(1, None, None, "a"), (1, "", None, None)])
    assert [(r.target, r.taken) for r in mixing.mix_sources(empty_texts).collect()] == [(0.0, 0), (0.0, 0)]


def vector_rows():
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal((30, 16))
    for i in range(400):
        c = centre[i % 30] + rng.standard_normal(16) * (0.08 if i % 3 else 0.4)
        rows.append([float(np.float32(x)) for x in c])
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return [(1000 - i, v, None if i % 41 == 40 else i % 2) for i, v in enumerate(rows)]


def test_op3_near_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("kept", F.lit(1)).withColumn("v", F.lit("x")).repartition(3)
    links, component = brute.links_of_vectors(rows, 0.93)
    # a window far smaller than the groups: the counts of links stay whole
    for window in (128, 16):
        got = table_of(neardup.near_vectors(df, window=window), "vec_id")
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
            i: (links[i], component[i], component[i] == i) for i, _, _ in rows
        }
    assert neardup.near_vectors(df.limit(0)).count() == 0


def test_op3_counts_in_blocks_are_those_of_one_block(spark):
    rows = [(i, v) for i, v, x in vector_rows() if x == 0 and v and len(v) == 16 and all(y is not None and math.isfinite(y) for y in v) and any(v)]
    unit = [(7, i, 1 + i % 3, [y / math.sqrt(sum(z * z for z in v)) for y in v]) for i, v in rows]
    df = spark.createDataFrame(unit, "component bigint, id bigint, copies bigint, v array<double>")
    assert sorted(neardup.link_counts(df, 0.93, 16).collect()) == sorted(neardup.link_counts(df, 0.93, 4096).collect())


def test_op3_passes_grow_with_the_largest_label():
    assert neardup.passes_for(100, 0.93) == 1 < neardup.passes_for(5_000, 0.93) < neardup.passes_for(10_000_000, 0.93)


def test_op3_keys_and_windows_read_columns_of_mixed_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [rng.standard_normal(d) for d in (3, 16, 3, 5, 16, 16, 3)]
    lists = pa.array([x.tolist() for x in rows], pa.list_(pa.float64()))[2:]
    read = {int(k): x for at, v in neardup._by_dim(lists) for k, x in zip(at, v)}
    assert len(read) == 5 and all((read[k] == rows[k + 2]).all() for k in read)
    keys = neardup._keys(neardup._by_dim(lists), 5, 1, 9, {})
    for k, x in enumerate(rows[2:]):
        sides = x @ np.random.default_rng([9, 1, len(x)]).standard_normal((len(x), 64)) > 0
        assert int(keys[k]) + 2**63 == int("".join("01"[int(s)] for s in sides), 2)
    # a window as wide as the label meets all its pairs, however the sorted rows fall into batches and ranges
    v = rng.standard_normal((60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(str(i % 2), 4, i, x.tolist(), 2) for i, x in enumerate(v)], "label string, dim int, id bigint, v array<double>, passes int")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        met = neardup.met_in_passes(df, 0.8, 30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got, want = list(range(60)), list(range(60))
    for group, links in ((got, [(r.a, r.b) for r in met]), (want, [(i, j) for i in range(60) for j in range(i) if (i - j) % 2 == 0 and v[i] @ v[j] >= 0.8])):
        for i, j in links:
            x, y = group[i], group[j]
            group[:] = [min(x, y) if z in (x, y) else z for z in group]
    assert got == want


def test_op3_meets_pairs_in_a_cone_and_in_a_dense_cluster(spark):
    rng, d = np.random.default_rng(4), 32
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows, pairs = [], []
    for label, n, mutual in ((0, 1600, 0.8), (1, 500, 0.88)):
        axis = unit(rng.standard_normal(d))
        off = rng.standard_normal((n, d))
        off = unit(off - (off @ axis)[:, None] * axis)
        v = math.sqrt(mutual) * axis + math.sqrt(1 - mutual) * off
        side = rng.standard_normal((n // 4, d))
        side = unit(side - np.sum(side * v[: n // 4], axis=1, keepdims=True) * v[: n // 4])
        mates = 0.935 * v[: n // 4] + math.sqrt(1 - 0.935**2) * side
        pairs += [(len(rows) + k, len(rows) + n + k) for k in range(n // 4)]
        rows += [(len(rows) + k, x.tolist(), label) for k, x in enumerate(np.concatenate((v, mates)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = table_of(neardup.near_vectors(df, window=8), "vec_id")
    apart = [p for p in pairs if got[p[0]].component_id != got[p[1]].component_id]
    assert not apart, f"{len(apart)} of {len(pairs)} pairs missed"


def quality_rows():
    rng = random.Random(8)
    rows = []
    for i in range(1000):
        good = rng.random() < 0.8
        text = prose(60, rng)
        if not good:
            text = [" | ".join(text.split()), text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60), text.replace(" ", "### ")][i % 4]
        rows.append((i, text, int(good)))
    return rows


def test_op4_learns_quality_from_positives_and_unlabelled(spark, docs, none):
    rows = quality_rows()
    df = frame(spark, [(i, t, None, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id bigint, quality int, toxic int")
    weights = quality.learn(df, labels, crc_mod("doc_id", 5) != 0)
    got = table_of(quality.score(df, weights))
    held = [(got[i], q) for i, _, q in rows if brute.fold(i, 5) == 0]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    odd_scores = quality.score(docs, weights, keep=("lang",)).collect()
    assert len(odd_scores) == docs.count() and all(0 <= r.score <= 1 for r in odd_scores)
    assert quality.score(none, weights).count() == 0
    # positives alone: the prior comes from the texts
    only = quality.learn(df, labels.filter("quality = 1"), crc_mod("doc_id", 5) != 0)
    got = table_of(quality.score(df, only))
    assert np.mean([got[i].predicted == q for i, _, q in rows if brute.fold(i, 5) == 0]) > 0.85
    assert quality.learn(df, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_op5_counts_are_those_of_greedy_longest_match(docs, none, odd):
    import public_tokenizers

    heads, tails = tokencount.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    h, t = set(heads), set(tails)
    got = table_of(tokencount.count_pieces(docs, heads, tails))
    for i, text, *_ in odd:
        w = brute.words(text)
        assert (got[i].n_words, got[i].n_tokens) == (len(w), sum(brute.greedy_pieces(b" " + x, h, t) for x in set(w) for _ in range(w.count(x)))), i
    assert tokencount.count_pieces(none, heads, tails).count() == 0


def test_op5_words_that_cannot_be_spelled_and_random_vocabularies():
    rng = random.Random(2)
    for _ in range(60):
        pieces = lambda n: list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(n)})
        heads, tails = pieces(6), pieces(6)
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))) for _ in range(40)]
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        got = tokencount.Automaton(heads, tails).lengths(data, np.cumsum(size) - size, size)
        assert got.tolist() == [brute.greedy_pieces(w, set(heads), set(tails)) for w in words]


@pytest.mark.parametrize("frequent", [2, 100])
def test_op6_components_are_those_of_all_pairs(docs, none, odd, monkeypatch, frequent):
    # two documents make a token frequent, so that links hang on token pairs alone
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    want = brute.near_duplicates([(i, t) for i, t, *_ in odd])
    got = table_of(jaccard.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    if frequent == 100:
        assert jaccard.near_duplicates(none).count() == 0


def test_op6_index_meets_every_similar_pair():
    rng = np.random.default_rng(4)
    for size in (2, 3, 5, 8, 17, 40, 133):
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            x = np.unique(pool[:size])
            y = x.copy()
            while True:
                z = np.unique(np.where(rng.random(len(y)) < 0.05, rng.choice(pool, len(y)), y))
                z = z if rng.random() < 0.5 else np.append(z, pool[-1])
                z = np.unique(z)
                both = len(np.intersect1d(x, z))
                if 175 * both < 75 * (len(x) + len(z)):
                    break
                y = z
                if rng.random() < 0.2:
                    break
            # any levels, as long as tokens of one set alone are never taken for shared ones
            level = {t: rng.integers(1, 3) for t in np.union1d(x, y)}
            share = rng.random()
            level = {t: 2 if rng.random() < share else v for t, v in level.items()}
            row = np.repeat([0, 1], [len(x), len(y)])
            tokens = np.concatenate([x, y])
            many = np.array([level[t] == 2 for t in tokens])
            of, keys = jaccard.index_keys(row, tokens, np.ones(len(row), bool), many, 2)
            if (len(x), len(y)) != (1, 1) and not np.array_equal(x, y):
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_op6_sketch_over_shards_counts_as_whole_counts_do(monkeypatch):
    monkeypatch.setattr(sketch, "SHARD_BITS", 6)
    rng, bits = np.random.default_rng(8), 12
    # no key, few, many; one that every parcel has more often than a byte counts
    parcels = [np.append(rng.choice(rng.integers(0, 1 << 63, 900, dtype=np.uint64), size), np.full(300 if size else 0, 5, np.uint64)) for size in (0, 3, 2000, 700)]
    cells = [sketch.cells_of(x, 0, bits).tolist() for x in parcels]
    times = Counter(c for x in cells for c in x)
    asked = pa.concat_tables([sketch.asked(k, x, bits) for k, x in enumerate(parcels)])
    shards = set(asked["shard"].to_pylist())
    assert len(shards) > 40
    said = pa.concat_tables([sketch.counted(asked.filter(pa.compute.equal(asked["shard"], s)), bits, (2, 100)) for s in shards])
    for k, keys in enumerate(parcels):
        got = sketch.answered(said.filter(pa.compute.equal(said["_parcel"], k)), keys, bits, 2)
        assert [x.tolist() for x in got] == [[times[c] >= t for c in cells[k]] for t in (2, 100)]


def test_op6_indexes_shared_tokens_only_however_many_texts_there_are(spark, docs, odd, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(300)]
    near = texts[7].replace(texts[7].split()[0], "other")
    # each text three times, one of them also with another word
    rows = [(i, t, None, None) for i, t in enumerate(texts * 3)] + [(5000, near, None, None), (None, near, None, None)]
    monkeypatch.setattr(jaccard, "PARCEL_CHARS", 2000)
    got = jaccard.indexed(frame(spark, rows), "doc_id", "text").filter(F.size("keys") > 0).collect()
    assert {r.doc_id for r in got} == {7, 5000} and all(len(r.tokens) == r.n for r in got)
    found = table_of(jaccard.near_duplicates(frame(spark, rows)))
    assert all(found[i].component_id == i % 300 for i in range(900)) and found[5000].component_id == 7
    # shards and parcels of any size
    monkeypatch.setattr(sketch, "SHARD_BITS", 7)
    got = table_of(jaccard.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.near_duplicates([(i, t) for i, t, *_ in odd])


def test_op6_rows_of_one_id_and_chains(spark):
    w = prose(100).split()
    chain = [" ".join([*(f"new{j}" for j in range(i)), *w[i:]]) for i in range(0, 60, 6)]
    rows = [(10 + k, t, None, None) for k, t in enumerate(chain)] + [(10, "other words that are quite different", None, None), (None, chain[0], None, None), (5, "other words that are quite different", None, None)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    want = brute.near_duplicates([(10 + k, t) for k, t in enumerate(chain)])
    assert got.pop(None) is None
    assert all(got[i] == (5 if c == 10 else c) for i, (_, c) in want.items()) and got[5] == 5


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(1)
    ids = list(range(300))
    rng.shuffle(ids)
    links = [(a, b) for a, b in zip(ids[:100], ids[1:100])] + [(ids[100], x) for x in ids[101:250]] + [(ids[260], ids[261]), (ids[261], ids[260])]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = brute.smallest_reachable(ids, links)
    assert got == {i: want[i] for i in {x for p in links for x in p}}


def test_op7_languages_of_held_out_texts(spark, docs, none):
    rng = random.Random(6)
    letters = {"aa": "abcdefgh", "bb": "opqrstuv", "cc": "éàüñßçö"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(4)) for _ in range(rng.randint(3, 60))), x, None) for i, x in enumerate(rng.choices(list(letters), k=200))]
    df = frame(spark, rows)
    got = table_of(langid.identify(df, crc_mod("doc_id", 4) != 2))
    assert all(got[i].lang_pred == x for i, _, x, _ in rows)
    mixed = langid.identify(docs, F.lit(True), keep=("source",))
    for r, text in ((r, t) for r in mixed.collect() for t in [r]):
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    blank = frame(spark, [(1, None, "en", None), (2, "", "en", None), (3, "12 !? --", "en", None)])
    assert {(r.lang_pred, r.score) for r in langid.identify(blank.unionByName(df), F.lit(True)).filter("doc_id < 4 and lang_pred = 'und'").collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(none, F.lit(True)).count() == 0


def test_op7_vectors_bind_order():
    own = langid.Profiles()
    v, total = own.bundles(["abc", "ABC", "cba", "", "a1b"])
    assert total.tolist() == [3, 3, 3, 0, 2]
    cosine = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    assert cosine(0, 1) == pytest.approx(1) and abs(cosine(0, 2)) < 0.3 and not v[3].any()


def test_op7_every_letter_has_its_own_vector():
    own = langid.Profiles()
    v = own.letters(np.array([ord(c) for c in "az\u00e9\u0436\u4e2d\u4e2e\ud55c\ud55d"]))
    cosine = v @ v.T / v.shape[1]
    assert (np.abs(cosine - np.eye(len(v))) < 0.25).all() and set(np.unique(v)) == {-1.0, 1.0}


def test_op7_matches_a_plain_version(spark):
    """Three languages in one script of thousands of letters, and one in Latin, against loops over letters."""
    rng = random.Random(8)
    scripts = [[chr(0x4E00 + k * 700 + i) for i in range(900)] for k in range(3)] + [list("abcdefghij")]
    words = [["".join(rng.choice(script) for _ in range(rng.randint(2, 4))) for _ in range(80)] for script in scripts]
    rows = []
    for i in range(160):
        k = rng.randrange(4)
        rows.append((i, "".join(rng.choice(words[k]) + rng.choice(["", " ", "1"]) for _ in range(rng.randint(20, 60))), f"l{k}", None))
    got = table_of(langid.identify(frame(spark, rows), crc_mod("doc_id", 4) != 2))
    own = langid.Profiles()

    def bundle(text):
        out = np.zeros(langid.DIMENSIONS)
        line = ["\n", *"".join(c if c.isalpha() else "\n" for c in text.lower()), "\n"]
        for x in zip(line, line[1:], line[2:]):
            if x[1] != "\n":
                a, b, c = (own.letters(np.array([ord(c) if c != "\n" else 0]))[0] for c in x)
                out += np.roll(a, 2) * np.roll(b, 1) * c
        return out / sum(c.isalpha() for c in text)

    bundles = {i: bundle(t) for i, t, *_ in rows}
    profiles = {}
    for i, _, x, _ in rows:
        if brute.fold(i, 4) != 2:
            profiles[x] = profiles.get(x, 0) + bundles[i]
    for i, _, x, _ in rows:
        cosines = {k: float(v @ bundles[i] / np.linalg.norm(v) / np.linalg.norm(bundles[i])) for k, v in profiles.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].score == pytest.approx(max(cosines[best], 0), abs=1e-5)
        assert got[i].lang_pred == best or cosines[got[i].lang_pred] == pytest.approx(cosines[best], abs=1e-5)
    held = [(got[i].lang_pred, x) for i, _, x, _ in rows if brute.fold(i, 4) == 2]
    assert sum(p == x for p, x in held) >= 0.8 * len(held)


def test_op8_removes_what_a_plain_version_removes(docs, none, odd, spark):
    want = brute.without_repeats([(i, t) for i, t, *_ in odd])
    got = table_of(substring.remove_repeats(docs, keep=("lang", "size")))
    for i, t, lang, _ in odd:
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept, r.lang, r["size"]) == (len(brute.words(t)), len(brute.words(t)) - len(want[i]), b" ".join(want[i]).decode(), lang, "x")
    assert any(r.n_removed for r in got.values())
    assert substring.remove_repeats(none).count() == 0
    passage = prose(55)
    same = frame(spark, [(3, passage, None, None), (3, passage + " z", None, None), (4, "y " + passage, None, None), (None, passage, None, None)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(same).collect()) == [(0, 0), (3, 0), (3, 0), (4, 55)]


def test_op8_sliding_minimum():
    rng = np.random.default_rng(1)
    for n in (0, 1, 45, 46, 47, 200):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert substring.sliding_min(x, 46).tolist() == [x[i : i + 46].min() for i in range(n - 45)]


def test_op9_base_score_counts_and_probabilities(docs, none, odd, spark):
    got = table_of(lm.score_texts(docs, crc_mod("doc_id", 5) != 1, keep=("lang",)))
    n, v, counts = brute.unigram([t for i, t, *_ in odd if brute.fold(i, 5) != 1], [(i, t) for i, t, *_ in odd])
    for i, t, lang, _ in odd:
        r, c = got[i], counts[i]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.lang) == (len(c), sum(x > 0 for x in c), n, lang)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    again = table_of(lm.score_texts(docs.repartition(5), crc_mod("doc_id", 5) != 1))
    assert all(math.isclose(again[i].score, got[i].score, rel_tol=1e-6) for i in got)
    assert lm.score_texts(none, F.lit(True)).count() == 0
    assert {r.score for r in lm.score_texts(docs, F.lit(False)).collect()} == {0.0}


def _seated(rng, n_words=40, n_contexts=12):
    """A shard that holds all words, after a sweep, its sums before and after, and its contexts' tables."""
    words = np.unique(rng.integers(0, 1 << 63, n_words, dtype=np.uint64))
    contexts = np.unique(rng.integers(0, 1 << 40, n_contexts, dtype=np.uint64))
    at = np.flatnonzero(rng.random(n_words * n_contexts) < 0.4)
    times = rng.choice([1, 1, 1, 2, 3, 60], len(at)).astype(np.int64)
    own = lm.Shard(lm.Pairs.of(words[at // n_contexts], contexts[at % n_contexts], times), 0, n_words)

    def tables():
        t = np.ones(len(own.pairs.times), np.int64)
        t[own.active] = own.tables
        return t

    def totals(of):
        return np.array([tables()[own.pairs.contexts == c].sum() for c in of])

    _, seats, repeated = (dict(zip(lm._NAMES, row)) for row in own.closed(0))
    less = lm.Seating.opened(seats, repeated, 0, n_words)
    for k in range(3):
        g = lm.Sums.of(own.stats())
        less.sweep(k, g, totals(own.contexts))
        own.sweep(k, g, totals(own.contexts))
        assert own.seating() == less.seating() and own.stats() == less.stats()
    return own, words, contexts, lm.Sums.of(own.stats()), tables()


def test_op9_probabilities_of_a_context_add_up_to_one():
    own, words, contexts, g, tables = _seated(np.random.default_rng(0))
    every = np.sort(np.append(words, np.uint64((1 << 63) + 5)))
    for c in (*contexts[:4], np.uint64(7)):
        asked = lm.Pairs.of(every, np.full(len(every), c))
        seen, below = own.answer(asked, g)
        mine = own.pairs.contexts == c
        customers, opened = own.pairs.times[mine].sum(), tables[mine].sum()
        p = (seen + (lm.STRENGTH + g.discount * opened) * below) / (lm.STRENGTH + customers)
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_op9_predictions_follow_the_restaurants():
    """Every probability against the three levels written out with dictionaries."""
    own, words, contexts, g, tables = _seated(np.random.default_rng(3))
    word_of = own.pairs.words[own.pairs.words_of()]
    seating = {(int(c), int(w)): (int(n), int(t)) for c, w, n, t in zip(own.pairs.contexts, word_of, own.pairs.times, tables)}
    class_customers, root_customers = Counter(), Counter()
    for (c, w), (_, t) in seating.items():
        class_customers[c % lm.CLASSES, w] += t
    class_tables = {(int(k), int(own.pairs.words[i])): int(t) for k, i, t in zip(own.cls, own.word, own.class_tables)}
    for (_, w), t in class_tables.items():
        root_customers[w] += t
    root_tables = {int(w): int(t) for w, t in zip(own.pairs.words, own.root_tables)}

    def share(n, t, d, all_n, all_t, below):
        return (n - d * t + (1 + d * all_t) * below) / (1 + all_n)

    for c in map(int, contexts):
        for w in map(int, words):
            k = c % lm.CLASSES
            p = share(root_customers[w], root_tables.get(w, 0), g.root_discount, sum(root_customers.values()), sum(root_tables.values()), 1 / 41)
            p = share(
                class_customers[k, w], class_tables.get((k, w), 0), g.class_discount, sum(n for (x, _), n in class_customers.items() if x == k),
                sum(t for (x, _), t in class_tables.items() if x == k), p,
            )
            n, t = seating.get((c, w), (0, 0))
            own_n, own_t = (sum(s[i] for (x, _), s in seating.items() if x == c) for i in (0, 1))
            want = share(n, t, g.discount, own_n, own_t, p)
            seen, below = own.answer(lm.Pairs.of(np.array([w], np.uint64), np.array([c], np.uint64)), g)
            assert (seen[0] + (1 + g.discount * own_t) * below[0]) / (1 + own_n) == pytest.approx(want, rel=1e-9)


def test_op9_pairs_survive_packing():
    rng = np.random.default_rng(4)
    word, context = rng.integers(0, 1 << 64, 50, dtype=np.uint64)[rng.integers(0, 50, 3000)], rng.integers(0, 1 << 40, 3000, dtype=np.uint64)
    pairs = lm.Pairs.of(word, context, places=True)
    again = lm.Pairs.unpacked(*pairs.packed(), lm.pack_counts(pairs.times))
    for field in ("words", "sizes", "contexts", "times"):
        assert (getattr(again, field) == getattr(pairs, field)).all()
    assert (np.repeat(pairs.words, pairs.sizes)[pairs.place] == word).all() and (pairs.contexts[pairs.place] == context).all()
    assert sum(len(p.contexts) for _, p in pairs.by_shard(7)) == len(pairs.contexts)


def test_op9_pairs_of_neighbouring_shards_are_sorted_together():
    words = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 4000, dtype=np.uint64))
    for shards in (1, 5, 8, 204):
        of = lm.shard_groups(words, shards)
        assert (np.diff(of.astype(int)) >= 0).all() and of.max() < lm.GROUPS
        for _, a, b in lm.by_shard(words >> np.uint64(64 - lm.CONTEXT_BITS), shards):
            assert len(set(of[a:b])) == 1
    x = np.float32([0.5, -3.25, 1e-30, 0])
    assert (lm.unpack_floats(lm.pack_floats(x)) == x).all() and not len(lm.unpack_floats(lm.pack_floats(x[:0])))


def test_stored_frames_lie_in_folders_and_can_be_forgotten(spark):
    df = stored(spark.range(100).select("id", (F.col("id") % 3).alias("k")).repartition(4, "id"), "test-stored", "k")
    assert df.columns == ["id", "k"] and df.filter("k = 1").count() == 33
    forget(df, "/k=1/")
    assert spark.read.parquet(df.inputFiles()[0].split("/k=")[0]).filter("k = 1").count() == 33
    assert {f.split("/k=")[1][0] for f in spark.read.parquet(df.inputFiles()[0].split("/k=")[0]).inputFiles()} == {"1"}


def test_op9_beats_a_bigram_model_on_held_out_texts(spark):
    """At least as good as interpolated Kneser-Ney on the previous word, per token of texts not learned from."""
    rng = np.random.default_rng(5)
    after = rng.integers(0, 300, (300, 4))
    rows = []
    for i in range(300):
        at, line = int(rng.integers(0, 300)), []
        for _ in range(60):
            line.append(f"w{at}x{at % 7}")
            at = int(after[at, rng.integers(0, 4)]) if rng.random() < 0.8 else int(300 * rng.random() ** 2)
        rows.append((i, " ".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm.score_texts(docs, crc_mod("doc_id", 5) != 1).collect() if brute.fold(r.doc_id, 5) == 1]
    ours = sum(r.score for r in got) / sum(r.n_tokens for r in got)
    theirs = brute.kneser_ney([t for i, t in rows if brute.fold(i, 5) != 1], [t for i, t in rows if brute.fold(i, 5) == 1])
    assert ours >= theirs - 0.02 and ours > sum(r.base_score for r in got) / sum(r.n_tokens for r in got) + 0.3


def test_op9_parcels_and_scores_do_not_depend_on_partitions(docs, spark, monkeypatch):
    """Shards follow from the texts; what a round or the sweeps stored is gone when the scores are there."""
    parcels, files = {}, {}

    def watched(df, label, *folders):
        out = stored(df, label, *folders)
        parcels.setdefault(label, []).append(out.count())
        files.setdefault(label, []).extend(out.inputFiles())
        return out

    monkeypatch.setattr(lm, "stored", watched)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scores = table_of(lm.score_texts(docs, crc_mod("doc_id", 5) != 1))
            seen.append(({k: v for k, v in parcels.items()}, {i: r.score for i, r in scores.items()}))
            parcels = {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0][0] == seen[1][0] and seen[0][1] == pytest.approx(seen[1][1], rel=1e-9)
    assert len(seen[0][0]["lm-scores"]) == lm.ROUNDS and sum(seen[0][0]["lm-scores"]) == docs.count()
    left = {k for k, paths in files.items() if any(os.path.exists(f.removeprefix("file:")) or os.path.exists(f.removeprefix("file://")) for f in paths)}
    assert left == {"lm-scores"}
    assert lm.shards_for(0) == lm.FEWEST and lm.shards_for(50_000_000_000) == 2084


def test_op9_tables_follow_their_distribution():
    d, a, c, n = 0.4, 0.7, 6, 40_000
    drawn = lm.draw_tables(np.full(n, c), np.full(n, a), d, np.random.default_rng(1))
    # seat customers by weights and add up over all orders of opening tables
    weight = {1: 1.0}
    for seated in range(1, c):
        after = {}
        for t, w in weight.items():
            after[t] = after.get(t, 0) + w * (seated - d * t)
            after[t + 1] = after.get(t + 1, 0) + w * a
        weight = after
    total = sum(weight.values())
    for t, w in weight.items():
        assert abs((drawn == t).mean() - w / total) < 0.01
    many = lm.draw_tables(np.array([5000] * 50), np.full(50, 0.5), 0.5, np.random.default_rng(2))
    assert (many >= 1).all() and (many <= 5000).all()


def test_op10_pieces_and_sequences(docs, none, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [r.asDict() for r in packing.pack(docs, path, public_tokenizers.PATTERN).collect()]
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in odd:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(of[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        assert [r["length"] for r in pieces][1:] == [2048] * (len(pieces) - 1)
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack(none, path, public_tokenizers.PATTERN).count() == 0


def test_op10_ids_are_those_of_the_file_for_any_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.Segments(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "don't", "'s", " ", "  ", "\n", "\t", " ", "　", "12", "é", "!?", "<|endoftext|>", "\x1c", "word", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for got, want in zip(own.batch(pa.array(texts)), plain.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids


def test_op10_completion_is_optimal_on_small_bins():
    def fewest(items, capacity):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                    place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    rng = random.Random(7)
    short = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {s: items.count(s) for s in items}
        packed = packing.complete(counts, 20)
        assert all(sum(p) <= 20 for p, _ in packed)
        used = {}
        for p, n in packed:
            for s in p:
                used[s] = used.get(s, 0) + n
        assert used == counts
        short += sum(n for _, n in packed) - fewest(items, 20)
    assert short == 0


def test_op10_search_completes_on_all_distinct_lengths():
    lengths = np.exp(np.random.default_rng(1).normal(5.8, 0.9, 60_000)).astype(int) + 1
    counts: dict[int, int] = {}
    for n in lengths:
        for _, size in packing.cut(int(n), 2048):
            counts[size] = counts.get(size, 0) + 1
    bound = -(-sum(s * n for s, n in counts.items()) // 2048)
    best = packing.complete(counts, 2048)
    held: dict[int, int] = {}
    for pattern, n in best:
        assert sum(pattern) <= 2048
        for s in pattern:
            held[s] = held.get(s, 0) + n
    assert held == counts
    assert sum(n for _, n in best) == bound < sum(n for _, n in packing.best_fit(counts, 2048))
