"""Centroid clustering with heap-ordered bounds, in exact integer arithmetic.

Lloyd's rounds, in which a vector is compared with all centroids only if its assignment can have changed. When a vector is
scanned, its distances to the nearest centroid (upper) and to the second nearest (lower) are known; centroids that move by
d1 (its own) and by d2 at most (any other) shrink the gap lower - upper by d1 + d2 at most. A cluster accumulates that sum as
its drift, and a vector enters the cluster's heap under ``key`` = gap + the drift so far: it stays untouched until the
drift reaches its key, then it is popped, scanned exactly and pushed on the heap of its cluster of then.

A heap is kept as sorted runs, as tables that do not fit in memory need it: a round writes what it popped and scanned as one
Parquet run, each file in order of (cluster, key). Popping is a filter of ranges of (cluster, key), one for each cluster, that
reaches the Parquet scan, where row groups beyond the drift are passed over by their statistics. A drift never falls, so
what was popped from a run is known from the last round's drifts and no row is ever updated; where runs hold more than
twice the vectors there are, those still live are merged in one run and the others removed.

Components are floor(256 x), distances their squared integers, centroids floor(sum / count), all exact: sums are kept by
adding what vectors popped bring to their new cluster and take from their old one, in a row for each task and cluster. Keys are
floating point and rounded so that a vector whose nearest centroid could be tied is always scanned. Only the centroids, their
drifts and sums (k rows each) come to the driver. No vector is shuffled; a cluster with most of them is no single task's work.

Vectors that are null, of another length or hold null or non-finite components take no part. Ties go to the smaller number.
Start centroids are the k vectors with the least hashes of their id, rows without an id last, rows of equal id by their
components; repeated rows may start a cluster each, of which the later stays empty and where it is. Of fewer than k vectors
each starts a cluster. An empty table gives no rows. Components beyond 2^27 (x beyond 524,288), whose squared distances a long
cannot hold, raise an error. Columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

K = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
SEED = 2
#: Up to so many clusters the ranges to pop are pushed down to the scan one by one, beyond that by their common bound.
PUSHED = 128
_MOST = 1 << 27
#: Bounds are widened by this part of themselves, far more than floating point loses.
_SLACK = 1e-9
RUN_DDL = "vec_id long, v array<int>, old int, cluster int, key double"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of integers) of the rows that take part."""
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where((F.size(vector) == components) & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(_flat(b.column(1)) * scale)
            if len(x) and np.abs(x).max() > _MOST:
                raise ValueError(f"a component beyond {_MOST / scale:g}: squared distances do not fit in a long")
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(x.astype(np.int32), components)], ["vec_id", "v"])

    return rows.mapInArrow(work, "vec_id long, v array<int>")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(x: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(x.size // width + 1, dtype=np.int32) * width), pa.array(x.ravel()))


def nearest_two(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the nearest centroid, its squared distance, and that of the next (the greatest long without one)."""
    best, first, second = (np.empty(len(x), np.int64) for _ in range(3))
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    small = 4 * x.shape[1] * int(most) ** 2 < 1 << 53  # then every term is exact as a double
    step = max(1, (1 << 22) // max(1, centroids.size))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        if small:
            f, c = part.astype(float), centroids.astype(float)
            d = ((f * f).sum(1)[:, None] - 2 * (f @ c.T) + (c * c).sum(1)).astype(np.int64)
        else:
            d = ((part[:, None, :] - centroids[None]) ** 2).sum(2)
        at = np.arange(len(part))
        best[a : a + step] = d.argmin(1)  # the first of equal ones
        first[a : a + step] = d[at, best[a : a + step]]
        d[at, best[a : a + step]] = np.iinfo(np.int64).max
        second[a : a + step] = d.min(1)
    return best, first, second


def _scan(rows: DataFrame, centroids: np.ndarray, drift: list[float]) -> DataFrame:
    """Exact scan of rows of (vec_id, v, old): their cluster and their key in its heap."""
    moved = np.array(drift)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _flat(b.column(1)).astype(np.int64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, centroids.shape[1]), np.int64)
            best, first, second = nearest_two(x, centroids)
            upper, lower = np.sqrt(first.astype(float)), np.sqrt(second.astype(float))
            key = lower - upper - _SLACK * (lower + upper) + moved[best]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(best.astype(np.int32)), pa.array(key)], ["vec_id", "v", "old", "cluster", "key"])

    return rows.select("vec_id", "v", "old").mapInArrow(work, RUN_DDL).sortWithinPartitions("cluster", "key")


def _changes(run: DataFrame, width: int) -> list:
    """(cluster, count, sums) of what each cluster gained, less what it lost; a row for each cluster that changed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = _flat(b.column(0)).astype(np.int64).reshape(b.num_rows, -1)
            for column, sign in ((b.column(2), 1), (b.column(1), -1)):
                cluster = column.to_numpy(zero_copy_only=False)
                for c in np.unique(cluster[cluster >= 0]).tolist():
                    mine = cluster == c
                    counts[c] = counts.get(c, 0) + sign * int(mine.sum())
                    sums[c] = sums.get(c, 0) + sign * x[mine].sum(0)
        if counts:
            flat = np.stack([sums[c] for c in counts])
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64()), _lists(flat, width)], ["cluster", "n", "sums"])

    moved = run.where("old <> cluster").select("v", "old", "cluster").mapInArrow(work, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return moved.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()


class Clusters(NamedTuple):
    """Vectors with their cluster and squared distance, the final centroids, how many vectors each pass scanned, and the
    pinned tables that ``rows`` reads."""

    rows: DataFrame
    centroids: list[list[int]]
    scanned: list[int]
    pinned: list[DataFrame]


class _Run(NamedTuple):
    table: DataFrame
    made: int
    n: int


def _among(levels: list[float]) -> Column:
    """Rows whose key is at most the level of their cluster, in a form that the scan can use."""
    if len(levels) <= PUSHED:
        return reduce(or_, [(F.col("cluster") == j) & (F.col("key") <= t) for j, t in enumerate(levels)])
    return (F.col("key") <= max(levels)) & (F.col("key") <= F.element_at(F.array(*[F.lit(t) for t in levels]), F.col("cluster") + 1))


def _live(run: _Run, t: int, levels: list[float]) -> DataFrame:
    """The rows of a run that were not popped up to pass ``t``, whose levels these were."""
    return run.table if run.made >= t else run.table.where(~_among(levels))


def _drifted(drift: list[float], old: list[list[int]], new: list[list[int]]) -> list[float]:
    moved = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * (1 + _SLACK) for x, y in zip(old, new, strict=True)]
    order = sorted(range(len(moved)), key=lambda j: -moved[j])
    others = [moved[order[1]] if j == order[0] and len(order) > 1 else 0.0 if len(order) == 1 else moved[order[0]] for j in range(len(moved))]
    return [d + m + o for d, m, o in zip(drift, moved, others, strict=True)]


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> Clusters:
    """Clusters of a table of (vec_id, v) as :func:`integer_vectors` makes it.

    ``rows`` are vec_id, cluster, distance. The last pass assigns to the centroids of the last round.
    """
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [list(r["v"]) for r in vectors.orderBy(by_hash.asc_nulls_last(), "v").limit(k).collect()]
    if not start:
        return Clusters(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), [], [], [])
    width = len(start[0])
    centroids, drift = start, [0.0] * len(start)
    counts, sums = [0] * len(start), [[0] * width for _ in start]
    runs: list[_Run] = []
    scanned: list[int] = []
    levels: list[float] = []
    for t in range(rounds + 1):
        if t == 0:
            popped = vectors.withColumn("old", F.lit(-1))
        else:
            before, levels = levels, [d * (1 + _SLACK) for d in drift]
            parts = [_live(r, t - 1, before).where(_among(levels)) for r in runs]
            popped = reduce(DataFrame.unionByName, parts).select("vec_id", "v", F.col("cluster").alias("old"))
        run = common.pin(_scan(popped, np.array(centroids, np.int64), drift), "cluster-run")
        n = run.count()
        runs.append(_Run(run, t, n))
        scanned.append(n)
        if t == rounds:
            break
        for r in _changes(run, width):
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + int(r[f"s{i}"]) for i, a in enumerate(sums[r["cluster"]])]
        moved = [[x // c for x in s] if c else old for s, c, old in zip(sums, counts, centroids, strict=True)]
        if sum(r.n for r in runs) > 2 * scanned[0]:
            whole = common.pin(reduce(DataFrame.unionByName, [_live(r, t, levels) for r in runs]).sortWithinPartitions("cluster", "key"), "cluster-run")
            common.unpin(*[r.table for r in runs])
            runs = [_Run(whole, t, scanned[0])]
        if moved == centroids:
            break
        centroids, drift = moved, _drifted(drift, centroids, moved)
    last, t = np.array(centroids, np.int64), len(scanned) - 1
    rows = reduce(DataFrame.unionByName, [_live(r, t, levels) for r in runs])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = _flat(b.column(2)).astype(np.int64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, width), np.int64), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(((x - last[c]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    measured = rows.select("vec_id", "cluster", "v").mapInArrow(measure, "vec_id long, cluster int, distance long")
    return Clusters(measured, centroids, scanned, [r.table for r in runs])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cluster_vectors(integer_vectors(common.table(spark, sf_dir, "embeddings")))
    rows = common.pin(made.rows, "clusters")
    common.unpin(*made.pinned)
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    whole = sum(inertia.values())
    named = [(c, x, whole, hashlib.sha256(",".join(map(str, made.centroids[c])).encode()).hexdigest()) for c, x in inertia.items()]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
