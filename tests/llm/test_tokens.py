"""Exact round trips against the tokenizer itself, and the Elias-Fano sequences."""

from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemark.llm import tokens

TOKENIZER = Tokenizer.from_file(tokens.TOKENIZER)
plain = lambda t: TOKENIZER.encode(t or "", add_special_tokens=False).ids


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r["start"])


def test_round_trip(spark, folder, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_DOCS", 40)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got, at = rows_of(tokens.read_token_files(tokens.write_token_files(docs, folder))), 0
    for r, doc in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*plain(doc["text"]), tokens.END_ID]
        assert tuple(r) == (doc["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_edges(spark, folder):
    rows = [(5, None), (None, "first"), (-3, ""), (5, "again"), (10**15, "x" * 100_000), (7, "a b " * 50_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    manifest = tokens.write_token_files(docs, folder)
    got = rows_of(tokens.read_token_files(manifest))
    assert [r["doc_id"] for r in got] == [None, -3, 5, 5, 7, 10**15]
    assert [r["n_tokens"] for r in got if r["doc_id"] == 7] == [100_001]
    assert sum(r["n_tokens"] for r in got) == sum(len(plain(t)) + 1 for _, t in rows)
    shard = tokens.ShardReader(max(manifest.collect(), key=lambda r: r["n_docs"])["path"])
    for i, (doc, _, ids) in enumerate(shard.scan(2)):
        assert shard.doc_id(i) == doc and shard.ids(i).tolist() == ids.tolist()
    assert tokens.read_token_files(tokens.write_token_files(docs.limit(0), folder + "/none")).count() == 0
    assert [r[0] for r in docs.where("doc_id = -3 or text is null").select(tokens.n_tokens()).collect()] == [0, 0]


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_any_text(text):
    enc = tokens.word_ids(tokens.TOKENIZER)
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == plain(text)


def test_hard_texts():
    enc = tokens.word_ids(tokens.TOKENIZER)
    for text in ("a\x1cb", "don't we'll", "İstanbul ŉ J̌ KÅ", "x<|endoftext|>y", "ΑΣ ΑΣ, 'S 's", "é. É,, abc.,. 12 3a4 _b ſecret Ŀ", "中文 한국어", " a\xa0b\x85c"):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == plain(text)


@settings(deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_elias_fano(values, a, b):
    values = np.array(sorted(values), np.int64)
    seq, _ = tokens.EliasFano.from_bytes(tokens.EliasFano.build(values).to_bytes())
    a, b = sorted((min(a, len(values)), min(b, len(values))))
    assert seq.slice(a, b).tolist() == values[a:b].tolist()
    assert all(seq.select(i) == values[i] for i in range(a, b, 97))


def test_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(tokens.EliasFano.build(ends).to_bytes()) < 50_000 * 13 / 8


def test_manifest_names_only_finished_shards(spark, folder):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    manifest = tokens.write_token_files(docs, folder)
    tokens.ShardWriter(folder, np.dtype("<u2"))  # an orphan of a lost task
    assert tokens.read_token_files(manifest).count() == 100
