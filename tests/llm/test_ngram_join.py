"""The join against brute force, its banding, and its edge cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from tidemark.llm import ngram_join as nj


def brute_force(rows, n=5, threshold=0.8):
    """id -> (class, links) by an inverted index over exact n-grams."""
    grams, index, edges, links = {}, defaultdict(list), [], Counter()
    for doc, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        k = min(n, len(words))
        grams[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else {text or ""}
        for other, shared in Counter(x for g in grams[doc] for x in index[g]).items():
            if shared >= threshold * (len(grams[doc]) + len(grams[other]) - shared) - 1e-9:
                edges.append((doc, other))
                links.update((doc, other))
        for g in grams[doc]:
            index[g].append(doc)
    parent = {d: d for d in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d in grams}


def joined(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nj.join_ngrams(df).collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert joined(docs) == brute_force([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])


def test_a_large_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_TEXTS", 16)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        words[i % 40] = f"x{i}"
        if i % 3 == 0:
            words[79] = f"y{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "a clean text of its own with number %d and more words %d" % (i, i * i)) for i in range(20)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "one two"), (5, "One, two"), (6, "two one"), (None, "one two"), (7, "w " * 30_000), (8, "w " * 20_000), (9, "???"), (9, "???")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, set_id int")
    got = sorted((r["doc_id"] or -1, r["class_id"], r["n_links"]) for r in nj.join_ngrams(docs).collect())
    assert got == [(-1, 4, 2), (1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 2), (5, 4, 2), (6, 6, 0), (7, 7, 1), (8, 7, 1), (9, 9, 1), (9, 9, 1)]
    kept = nj.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 9]
    assert nj.join_ngrams(docs.limit(0)).count() == 0


def test_banding():
    bands, rows = nj.choose_bands(0.8, 0.9999)
    assert bands * rows <= nj.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        nj.choose_bands(0.1, 0.9999, 8)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (101, 103), (102, 103), (7, 7)]
    got = {r["node"]: r["label"] for r in nj.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in (101, 102, 103)} == {100}
    assert nj.components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0
