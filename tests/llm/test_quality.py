"""The ranking on held-out labels, its fit against plain gradient descent, its threshold and its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from tidemark.llm import common, quality
from tidemark.llm.words import slices


def auc(rows):
    good, poor = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in good for b in poor) / (len(good) * len(poor))


def test_held_out(spark):
    got = quality.op12_quality(spark, MEDIUM).join(common.table(spark, MEDIUM, "labels"), "doc_id", "left").collect()
    assert len(got) == common.table(spark, MEDIUM, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], r["quality"]) for r in got if r["held_out"] and r["quality"] is not None]
    assert len(held) > 60 and auc(held) > 0.97
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in held]) > 0.95


def test_fit_is_the_minimum_of_the_pairwise_loss():
    rng = np.random.Generator(np.random.PCG64(2))
    good, poor = rng.normal(0.5, 1, (40, 3)), rng.normal(0, 1, (25, 3))
    w = quality.fit_pairs(good, poor, partners=5, ridge=0.01)
    sd = np.concatenate([good, poor]).std(0)
    a, b = quality.pairs(40, 25, 5)

    def loss(v):
        return np.log1p(np.exp(-((good[a] - poor[b]) / sd) @ v)).mean() + 0.005 * (v @ v)

    v = w * sd
    for j in range(3):
        for step in (1e-3, -1e-3):
            moved = v.copy()
            moved[j] += step
            assert loss(moved) > loss(v)


@pytest.mark.parametrize(("n", "m"), [(7, 3), (3, 7), (1, 1), (50, 2), (40, 33)])
def test_pairs_are_even(n, m):
    a, b = quality.pairs(n, m, 4)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a) == max(n, m) * min(4, n, m)
    for side, size in ((a, n), (b, m)):
        uses = np.bincount(side, minlength=size)
        assert uses.min() >= 1 and uses.max() - uses.min() <= 1


def features_of(text):
    return quality._features(next(iter(slices(pa.array([text], pa.string())))))[1][0]


def test_features():
    names = quality.FEATURES
    f = dict(zip(names, features_of("THE cat cat cat !! ## a1 Word"), strict=True))
    assert f["capitals"] == 1 / 8 and f["bare"] == 2 / 8 and f["doubled"] == 2 / 8 and f["stutter"] == 2 / 7 and f["repeated"] == 1 / 7
    chars = len("THEcatcatcat!!##a1Word")
    assert f["signs"] == pytest.approx(4 / chars) and f["digits"] == pytest.approx(1 / chars) and f["upper"] == pytest.approx(4 / chars)
    assert not features_of("").any() and not features_of(None).any() and not features_of("\n ").any()
    assert np.allclose(features_of("some words " * 20_000)[:4], features_of("some words " * 200)[:4], atol=0.01)


def corpus(n=200):
    rows = []
    for i in range(n):
        good = i % 5 > 0
        words = [f"w{(i * 7 + j * 3) % 90}{'abc'[j % 3]}" for j in range(30 + i % 17)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return rows


def test_threshold_is_the_quantile_of_all_labelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, pair_rows=20)
    got = {r["doc_id"]: r for r in model.score(docs.withColumn("fold", F.lit("x"))).collect()}
    seen = [r for r in rows if not __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i]["score"] < 0.3 for i, _, _ in seen) == sum(q == 0 for _, _, q in seen)
    assert all((got[i]["score"] >= 0.3) == (q == 1) for i, _, q in rows) and got[0]["fold"] == "x"


def test_edges(spark, folder):
    rows = [(i, t) for i, t, _ in corpus(60)] + [(None, "no id"), (100, None), (101, ""), (102, "  \n"), (103, "word " * 50_000), (7, corpus(60)[7][1]), (7, "other text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("score", "_quality", "n", "x", "quality", "f")})
    marks = [(i, q) for i, _, q in corpus(60)] + [(None, 1), (7, None), (7, 0), (8, 5)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").withColumns({c: F.lit(c) for c in ("text", "x")})
    model = quality.train(docs, labels)
    out = model.score(docs)
    got = out.collect()
    assert sorted(out.columns) == sorted(docs.columns) and len(got) == len(rows) and all(r["quality"] == "quality" for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[100] == by[101] == by[102] == model.share and 0 <= by[103] <= 1
    assert len({r["score"] for r in got if r["doc_id"] == 7 and r["text"] == rows[7][1]}) == 1
    for none in (labels.limit(0), labels.where("quality = 1")):
        m = quality.train(docs, none)
        assert m.weights == [] and {r["score"] for r in m.score(docs).collect()} == {m.share}
    assert model.score(docs.limit(0)).count() == 0
    assert quality.train(docs.limit(0), labels).weights == []
