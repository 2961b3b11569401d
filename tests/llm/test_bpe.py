"""Byte-pair encoding against the file's own tokenizer, and the round trip."""

import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from spreadlake.llm.bpe import LONG, Encoder, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(own, library, texts):
    ids, counts = own.batch(pa.array(texts, pa.large_string()))
    ends = np.concatenate(([0], np.cumsum(counts)))
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == want.ids, texts[k][:100]
    back = [b.decode("utf-8", "replace") for b in own.vocabulary.decode(ids, counts)]
    assert back == texts


def test_random_texts_of_awkward_characters(own, library):
    rng = np.random.default_rng(3)
    letters = ["a", "b", " ", " ", "\n", "\t", "'s", "'re", "1", "é", "中", "<|endoftext|>", "!", "\x1c", "\x85", "​", "😀", "\r\n", " the"]
    same(own, library, ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(4000)])


def test_every_block_of_characters(own, library):
    points = [c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    same(own, library, [f"x{chr(c)}x 1{chr(c)}1 {chr(c)}" for c in points])


def test_long_fragments(own, library):
    rng = np.random.default_rng(4)
    same(own, library, ["a" * 5000, "ab" * 2000, "".join(rng.choice(list("abcdefgh"), 5000)), "x" * (LONG - 1), "x" * LONG, "", "😀" * 300])


def test_no_entry_crosses_a_forced_boundary(own):
    known = own.vocabulary
    for i in range(0, len(known.size) - 1, 97):
        raw = np.frombuffer(known.decode(np.array([i]), np.array([1]))[0], np.uint8)
        assert not known.forced[raw[:-1], raw[1:]].any()
    assert known.forced[ord("e"), ord(" ")] and not known.forced[ord(" "), ord("t")]


def test_ids_that_spell_no_text(own, library):
    ids = np.array([0, 50_000, 120, 222, 60_000, 50_256], np.uint32)
    got = own.vocabulary.decode(ids, np.array([6]))[0].decode("utf-8", "replace")
    assert got == library.decode(ids.tolist(), skip_special_tokens=False)


def test_operator_rows(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("ids", T.IntegerType())]])
    rows = [(1, None, 5), (2, "", 5), (3, "same text", 5), (3, "same text", 6), (None, "x" * 3000 + " <|endoftext|>", 1)]
    got = decode(encode(spark.createDataFrame(rows, schema), PATH, public_tokenizers.PATTERN), PATH)
    assert sorted((r.doc_id or 0, r.decoded) for r in got.collect()) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert encode(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN).count() == 0
    packed = spark.createDataFrame([(1, None, "a"), (2, bytearray(b"\x40\0\0\0"), "b")], "n int, ids binary, decoded string")
    assert [(r.n, r.decoded) for r in decode(packed, PATH).orderBy("n").collect()] == [(1, None), (2, "a")]


def test_query_is_the_librarys(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op13_bpe_round_trip"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
