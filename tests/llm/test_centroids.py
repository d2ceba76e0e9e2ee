"""Clusters against Lloyd's rounds in plain integers, and what the heaps save."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, common


def plain(rows, k=40, rounds=5):
    """(id, cluster, distance) of rows of (id, integers), and the centroids."""
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(rows, key=lambda r: (*digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in rows]
        for j in range(len(c)):
            members = [v for (_, v), m in zip(rows, mine) if m == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], c


def vectors(spark, rows, partitions=3):
    return common.pin(spark.createDataFrame(rows, "vec_id long, v array<int>").repartition(partitions), "vectors")


@pytest.mark.parametrize("kind", ["noise", "clusters", "ties", "repeats", "few", "large"])
def test_against_plain_rounds(spark, kind):
    r = random.Random(3)
    if kind == "noise":
        rows = [(i, [r.randint(-300, 300) for _ in range(6)]) for i in range(400)]
    elif kind == "clusters":
        middle = [[r.randint(-3000, 3000) for _ in range(6)] for _ in range(12)]
        rows = [(i, [x + r.randint(-20, 20) for x in middle[i % 12]]) for i in range(600)]
    elif kind == "ties":
        rows = [(i, [i % 7, i % 3]) for i in range(200)]
    elif kind == "repeats":
        rows = [(i % 50, [i % 50, 5, -i % 4]) for i in range(300)] + [(None, [1, 2, 3]), (None, [1, 2, 3]), (None, [-900, 2, 3])] + [(60 + i, [7, 7, 7]) for i in range(200)]
    elif kind == "few":
        rows = [(i, [i, -i]) for i in range(3)]
    else:
        rows = [(i, [r.randint(-(1 << 27), 1 << 27) for _ in range(4)]) for i in range(150)]
    k = 10
    made = centroids.cluster_vectors(vectors(spark, rows), k=k)
    expected, c = plain(rows, k)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(x) for x in made.rows.collect()), key=key) == sorted(expected, key=key)
    assert made.centroids == c
    assert made.scanned[0] == len(rows)


def test_heaps_spare_most_scans(spark):
    """Well-separated groups: after the centroids have settled nearly nothing is popped, and every result is still exact."""
    r = random.Random(5)
    middle = [[r.randint(-20_000, 20_000) for _ in range(8)] for _ in range(8)]
    rows = [(i, [x + r.randint(-40, 40) for x in middle[i % 8]]) for i in range(800)]
    made = centroids.cluster_vectors(vectors(spark, rows), k=8, rounds=8)
    expected, _ = plain(rows, 8, 8)
    assert sorted(map(tuple, made.rows.collect())) == sorted(expected)
    assert sum(made.scanned[1:]) < 3 * len(rows) and made.scanned[-1] < len(rows) // 10
    assert len(made.pinned) <= len(made.scanned)


def test_popping_reaches_the_scan(spark):
    rows = vectors(spark, [(i, [i, i]) for i in range(100)])
    run = common.pin(centroids._scan(rows.withColumn("old", F.lit(-1)), __import__("numpy").array([[0, 0], [90, 90]]), [0.0, 0.0]), "run")
    plan = run.where(centroids._among([1.0, 2.0]))._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "LessThanOrEqual(key" in pushed and "EqualTo(cluster" in pushed
    many = run.where(centroids._among([float(i) for i in range(200)])).count()
    assert many == sum(1 for x in run.collect() if x["key"] <= x["cluster"])


def test_runs_are_merged(spark):
    """What is popped again and again does not add up on disk."""
    r = random.Random(1)
    rows = [(i, [r.randint(-100, 100) for _ in range(3)]) for i in range(300)]
    made = centroids.cluster_vectors(vectors(spark, rows), k=12, rounds=12)
    assert sum(t.count() for t in made.pinned) <= 3 * len(rows)
    assert sorted(map(tuple, made.rows.collect())) == sorted(plain(rows, 12, 12)[0])


def test_rows_that_take_no_part(spark, folder):
    good = [math.sin(i) for i in range(64)]
    rows = [(1, good), (2, None), (3, good[:-1]), (4, [*good[:-1], None]), (5, [*good[:-1], float("nan")]), (6, [*good[:-1], float("inf")]), (7, [0.0] * 64), (8, []), (None, good)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("cluster", "v", "key", "old", "distance")})
    got = centroids.integer_vectors(df).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 7]
    assert next(r["v"] for r in got if r["vec_id"] == 1) == [math.floor(256 * x) for x in good]
    df.write.parquet(f"{folder}/a/embeddings.parquet")
    out = {r["vec_id"]: r for r in centroids.op11_centroids(spark, f"{folder}/a").collect()}
    assert {i: r["distance"] for i, r in out.items()} == {None: 0, 1: 0, 7: 0} and out[1]["inertia"] == 0
    df.limit(0).write.parquet(f"{folder}/b/embeddings.parquet")
    assert centroids.op11_centroids(spark, f"{folder}/b").count() == 0
    with pytest.raises(Exception, match="do not fit"):
        centroids.integer_vectors(spark.createDataFrame([(1, [1e9] * 64)], df.schema.fields[0].name + " long, embedding array<double>")).collect()
