"""Recall against brute force, exact scores and ties, and vectors that take no part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from tidemark.llm import ann

DDL = "vec_id long, embedding array<float>, label int"


def truth(ids, x, query, k):
    """The k nearest others of one row: by falling score, then id."""
    scores = [(-float((x[query].astype(float) * v.astype(float)).sum()), int(i)) for i, v in zip(ids, x, strict=True) if i != ids[query]]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_small_table_is_exact(spark):
    rows = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    got = results(ann.op3_ann(spark, MEDIUM))
    assert sorted(got) == [i for i in ids.tolist() if i % ann.QUERY_STEP == 0]
    for q, found in got.items():
        expected = truth(ids, x, int(np.flatnonzero(ids == q)[0]), ann.K)
        assert [i for i, _ in found] == [i for i, _ in expected]
        assert np.allclose([s for _, s in found], [s for _, s in expected], atol=1e-12)


def test_recall_over_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 2
    x = (centres[rng.integers(0, 12, 2400)] + rng.standard_normal((2400, 16))).astype(np.float32)
    x[800:1600] = x[0]  # a third of the rows are one vector
    ids = np.arange(2400)
    got = results(ann.search(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], DDL), F.col("vec_id") % 20 == 0))
    assert len(got) == 120
    hits = 0
    for q, found in got.items():
        expected = truth(ids, x, q, ann.K)
        hits += len({i for i, _ in found} & {i for i, _ in expected})
        assert found == sorted(found, key=lambda r: (-r[1], r[0])) and q not in [i for i, _ in found]
    assert hits / (120 * ann.K) >= 0.9


def test_recall_of_queries_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    fitted, asked = [], []
    fit, choose = ann.fit_router, ann.choose_probes
    monkeypatch.setattr(ann, "fit_router", lambda x, n: fitted.append(x) or fit(x, n))
    monkeypatch.setattr(ann, "choose_probes", lambda *a: asked.append(a[2]) or choose(*a))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], DDL)
    got = results(ann.search(rows, F.col("vec_id") % 10 == 0, sample_rows=600))
    inside = {tuple(v) for v in fitted[0]}
    assert len(inside) == 600 and len(asked[0][0]) == ann.CALIBRATION_QUERIES
    assert not inside & {tuple(v) for v in asked[0][1]}
    unseen = [q for q in got if tuple(x[q].astype(float)) not in inside]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth(np.arange(4000), x, q, ann.K)}) for q in unseen)
    print("recall", hits / (len(unseen) * ann.K))
    assert len(unseen) > 300 and hits / (len(unseen) * ann.K) >= 0.93


def parts_visited(monkeypatch):
    """What later searches use: (parts, probes) of each."""
    seen, visit = [], ann.visit
    monkeypatch.setattr(ann, "visit", lambda assigned, routers, is_query, probes, k: seen.append((len(routers.parts), probes)) or visit(assigned, routers, is_query, probes, k))
    return seen


def test_registered_query_at_a_tenth(spark, monkeypatch):
    seen = parts_visited(monkeypatch)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    got = results(ann.op3_ann(spark, "/root/testdata/sf0.1"))
    assert seen[0][0] >= 4 and sorted(got) == [i for i in ids.tolist() if i % ann.QUERY_STEP == 0]
    hits = 0
    for q, found in got.items():
        expected = truth(ids, x, int(np.flatnonzero(ids == q)[0]), ann.K)
        hits += len({i for i, _ in found} & {i for i, _ in expected})
    print("parts and probes", seen, "recall", hits / (len(got) * ann.K))
    assert hits / (len(got) * ann.K) >= 0.9


def test_parts_of_parts_on_clusters(spark, monkeypatch):
    seen = parts_visited(monkeypatch)
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((24, 16))
    centres *= 6 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = (centres[rng.integers(0, 24, 6000)] + 0.5 * rng.standard_normal((6000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], DDL)
    got = results(ann.search(rows, F.col("vec_id") % 20 == 0, sample_rows=1000))
    parts, probes = seen[0]
    hits = sum(len({i for i, _ in found} & {i for i, _ in truth(np.arange(6000), x, q, ann.K)}) for q, found in got.items())
    print("parts and probes", seen, "recall", hits / (300 * ann.K))
    assert len(got) == 300 and hits / (300 * ann.K) >= 0.9
    assert parts > 32 and probes <= parts / 2  # a sample of 1,000 supports 16 at once


def test_surplus_rows_of_a_vector(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0], 0) for i in range(90)], DDL)
    left = ann.without_surplus(ann.valid_vectors(rows), 5)
    assert sorted(r["vec_id"] for r in left.collect()) == sorted([i for i in range(90) if i % 3 == 0] + [i for i in range(90) if i % 3][:6])


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i % 7), 1.0, -2.0], 0) for i in range(1, 9)]
    bad = [(20, None, 0), (40, [0.0, 0.0, 0.0], 0), (60, [1.0, None, 2.0], 0), (80, [float("nan"), 1.0, 1.0], 0), (100, [float("inf"), 1.0, 1.0], 0), (120, [1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(good + [(0, [1.0, 1.0, 1.0], 0), (0, [1.0, 1.0, 1.0], 0)] + bad, DDL)
    got = results(ann.search(df, F.col("vec_id") % 20 == 0))
    assert set(got) == {0} and sorted(i for i, _ in got[0]) == list(range(1, 9))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_an_id_is_one_query(spark):
    """Repeated query rows, and two vectors under one id, give each neighbour once and the list of a single vector."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(20, x[20].tolist(), 0)] * 3 + [(40, x[41].tolist(), 0)]
    got = results(ann.search(spark.createDataFrame(rows, DDL), F.col("vec_id") % 20 == 0))
    assert sorted(got) == list(range(0, 300, 20))
    once = [i for i in range(300)] + [20] * 3 + [40]
    ids, all_x = np.array(once), np.concatenate([x, x[[20, 20, 20, 41]]])
    for q in (20, 40):
        assert len(got[q]) == ann.K
        found = {tuple(i for i, _ in got[q])}
        options = {tuple(i for i, _ in truth(ids, all_x, k, ann.K)) for k in np.flatnonzero(ids == q)}
        assert found <= options or len(found & options) == 0 and any(len(set(next(iter(found))) & set(o)) >= 0.9 * ann.K for o in options)
    assert len({i for i, _ in got[20]}) == ann.K and len({i for i, _ in got[40]}) == ann.K


def test_cut_is_balanced():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((200, 8)) + c for c in (rng.standard_normal((4, 8)) * 6)]).astype(np.float32)
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_cut(graph, 4)
    assert np.bincount(part).tolist() == [200] * 4
    assert (part[graph] == part[:, None]).mean() > 0.8
