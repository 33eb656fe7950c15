"""Byte-level BPE against the tiktoken library, round trips, offsets and split characters."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsurvey.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.build_model(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)


TEXTS = ["", " ", "\n\n  x", "Hello world's <|endoftext|>", "naïve Straße 東京 🤖🏽", "a" * 30_000, "\t" * 999 + "end",
         "x y z　", "١٢٣ 42", "é" * 50, "'s 'LL 'll"]


def test_same_ids_as_tiktoken(encoder, reference):
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.batch(TEXTS)] == [reference.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own, ref = test_any_text.both
    assert np.frombuffer(own.batch([text])[0], "<u4").tolist() == ref.encode_ordinary(text)


@pytest.fixture(scope="module", autouse=True)
def _both(encoder, reference):
    test_any_text.both = encoder, reference


def test_offsets_and_split_characters(spark):
    docs = spark.createDataFrame([(1, "a 🤖 b", "c"), (2, None, "c"), (2, "", "c"), (None, "é", None)], "doc_id long, text string, ids string")
    rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 4
    for row in rows:
        text = {1: "a 🤖 b", None: "é"}.get(row.doc_id, "")
        starts, ends = np.frombuffer(row.starts, "<u4"), np.frombuffer(row.ends, "<u4")
        assert len(starts) * 4 == len(row.ids) and all(0 <= a < b <= len(text) for a, b in zip(starts, ends))
        assert set(range(len(text))) == {i for a, b in zip(starts, ends) for i in range(a, b)}
    whole = spark.createDataFrame([(1, rows[0].ids), (2, rows[0].ids[:8]), (3, None)], "doc_id long, ids binary")
    back = byte_bpe.decode(whole, RANKS)
    got = {r.doc_id: (bytes(r.data), r.t) for r in back.withColumn("t", byte_bpe.decoded_text(F.col("data"))).collect()}
    assert got[1] == ("a 🤖 b".encode(), "a 🤖 b") and got[3] == (b"", "")
    assert "a 🤖 b".encode().startswith(got[2][0]) and got[2][1].startswith("a")


def test_query_round_trip(spark, small, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_byte_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.asarray(reference.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_query_offsets(spark, small, reference):
    """The digest over first characters and ends of all tokens, found from the bytes of each token."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_byte_bpe"](spark, small).collect():
        text, at, starts, ends = texts[r.doc_id], 0, [], []
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        for i in reference.encode_ordinary(text):
            n = len(reference.decode_single_token_bytes(i))
            starts.append(owner[at])
            ends.append(owner[at + n - 1] + 1)
            at += n
        packed = np.asarray(starts, "<u4").tobytes() + np.asarray(ends, "<u4").tobytes()
        assert r.offsets_sha256 == hashlib.sha256(packed).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
