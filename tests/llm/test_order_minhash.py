"""Fingerprints against a plain version of the same definition, and the contract's columns."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import order_minhash as om


def check_columns(docs, got):
    """docs: (id, text) in any order; got: rows of the query, ids distinct."""
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    prints = {}
    for i, (doc, text) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        r = by_id[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, f) == f
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1
        if follower == text:
            assert r["near_next"] == 1


def test_documents(spark):
    got = om.op2_order_minhash(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check_columns([tuple(r) for r in docs], got)
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.08 > 0.02 > mean("near_next")


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edges(spark, ranges):
    rows = [(9, None), (-4, ""), (3, "é"), (None, "no id here"), (2, "a b c d e f g h"), (1, "日本語のテキスト"), (10**17, "a " * 60_000), (10**17 - 1, "same words"), (0, "same words")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, sketch int")
    check_columns(rows, om.fingerprint_edits(docs, ranges).collect())
    assert om.fingerprint_edits(docs.limit(0)).count() == 0
    assert om.fingerprint_edits(docs.limit(1), ranges).count() == 1


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x y z")] * 3 + [(0, "last one")], "doc_id long, text string")
    got = om.fingerprint_edits(docs, 4).orderBy("doc_id").collect()
    assert len(got) == 4 and sorted(r["near_next"] for r in got if r["doc_id"] == 1) == [0.0, 1.0, 1.0]


def test_sensitive_to_order_and_repeats(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {
        "base": words, "moved": words[200:] + words[:200], "edited": [f"x{i}" if i % 40 == 0 else w for i, w in enumerate(words)],
        "other": [f"z{i}" for i in range(400)], "twice": words + words,
    }
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string")
    s = om.with_fingerprint(df, "text").select("k", "text", "sketch")
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, F.lit(True)).select(F.col("a.k"), F.col("b.k").alias("l"), F.col("a.sketch").alias("s"), F.col("b.sketch").alias("t"), F.col("a.text").alias("u"), F.col("b.text").alias("v"))
    near = {(r["k"], r["l"]): r["n"] for r in pairs.select("k", "l", om.likeness("s", "t", F.col("u") == F.col("v")).alias("n")).collect()}
    assert near["base", "base"] == 1 and near["base", "other"] == 0
    assert near["base", "edited"] > 0.6
    assert near["base", "moved"] < 0.75  # about half of the pairs keep their order
    assert 0 < near["base", "twice"] < 0.7


def tuples_of(words, hash_kmer, hash_element):
    """The definition, one step at a time: the least elements from each starting point on, in text order."""
    seen, elements = {}, []
    kmers = [tuple(words[i : i + om.K]) for i in range(max(1, len(words) - om.K + 1))] if words else []
    for at, kmer in enumerate(kmers):
        n = seen[kmer] = seen.get(kmer, -1) + 1
        elements.append((hash_element(hash_kmer(kmer), n), at))
    out = []
    for start in range(om.TUPLES):
        turned = sorted(elements, key=lambda x: ((x[0] - start * (1 << 36) // om.TUPLES) % (1 << 36), x[1]))
        out.append([v for v, _ in sorted(turned[: om.L], key=lambda x: x[1])])
    return out


def test_against_the_definition(spark):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def kmer_hash(kmer):
        h = 42
        for w in kmer:
            inner = signed(xxhash.xxh64_intdigest(w.encode(), 42))
            h = xxhash.xxh64_intdigest(inner.to_bytes(8, "little", signed=True), h)
        return h >> 28

    texts = ["a b c a b c a b c d e a b", "one", "", " ".join(f"t{i % 37}" for i in range(300))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["sketch"] for r in om.with_fingerprint(got, "text").collect()}
    for i, t in enumerate(texts):
        # an occurrence number is hashed as a 4-byte int after the 8-byte k-mer hash
        element = lambda h, n: xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)) >> 28
        assert len(got[i]) == om.TUPLES
        for b, values in enumerate(tuples_of(t.split(), kmer_hash, element)):
            h = 0
            for v in values:
                h = signed(xxhash.xxh64_intdigest(v.to_bytes(8, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), 42)))
            assert got[i][b] == (h if values else None)


def test_moved_halves_of_a_short_text(spark):
    near = []
    for seed in range(40):
        words = [f"w{seed}x{i}" for i in range(20)]
        near.append((" ".join(words), " ".join(words[10:] + words[:10]), " ".join(sorted(words, key=lambda w: w[::-1]))))
    df = spark.createDataFrame(near, "a string, b string, c string")
    for c in "abc":
        df = om.with_fingerprint(df, c, f"s{c}")
    got = df.select(om.likeness("sa", "sb", F.lit(False)).alias("moved"), om.likeness("sa", "sc", F.lit(False)).alias("mixed"), om.likeness("sa", "sa", F.lit(True)).alias("same")).collect()
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("same") == 1 and 0.2 < mean("moved") < 0.65 and mean("mixed") < 0.2  # about half of the pairs keep their order


def test_hot_ids_fill_several_ranges(spark):
    rows = [(None, f"no id {i}") for i in range(400)] + [(7, f"seven {i}") for i in range(400)] + [(100 + i, f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = om.with_next(docs, 24)
    sizes = [r["count"] for r in placed.where("not _visitor").groupBy("_range").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) > 18 and max(sizes) < 120
    got = [(r["text"], r["_next"]) for r in placed.where("not _visitor").collect()]
    assert {t for t, _ in got} == {n for _, n in got} == {t for _, t in rows}  # one ring through all rows
    after, at, seen = dict(got), rows[0][1], set()
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == 1200


def test_many_ranges_take_a_short_plan(spark):
    """Bounds of 16,000 ranges are one text each; the plan is built and analysed at once."""
    cuts = [(k, (1 << 63) - 1) for k in range(16_000, 0, -1)]
    began = time.perf_counter()
    placed = spark.range(0, 20_000, 7).select(F.col("id").alias("_key"), F.xxhash64("id").alias("_tie")).withColumn("r", om._place(cuts))
    placed._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5
    assert all(r["r"] == max(0, 16_000 - r["_key"]) for r in placed.collect())
