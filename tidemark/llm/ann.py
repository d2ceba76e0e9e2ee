"""Approximate nearest neighbours by learned partitions, nearest meaning largest inner product.

1. On a bounded sample (``SAMPLE_ROWS``, the rows with the least id hashes) a neighbour graph is built and cut into balanced
   parts by recursive bisection: a smoothed vector of the graph is split at its median, then pairs of nodes that sit on the
   wrong sides are swapped.
2. A small network learns, for each sampled vector, how its neighbours are spread over the parts.
3. *Every* row is assigned to its most probable part. There is a part for each ``PART_ROWS`` rows (four at least, from
   ``LEAST_ROWS`` rows on); a sample supports a part for each ``PART_SAMPLE`` of its rows, so where the table asks for more,
   each part is sampled, cut and learned in turn, by a task of its own. A row then goes down two networks.
4. A query goes to its ``probes`` most probable parts, by the product of both networks' probabilities. It is scored in
   double precision against the rows of each part, which are held in blocks of bounded size; a task passes on a query's k
   best, and these are ranked by a window.

``probes`` is the least number at which a bounded sample of queries that the networks have not seen, searched by brute force
over all rows, finds ``recall`` of its true neighbours: on vectors without structure it comes near the number of parts, on
clustered ones it is small.

A row is shuffled once for its part and block, and again only where more than ``BLOCK_QUERIES`` queries visit the part; a
query is shuffled once for each block of the parts it visits. Of equal vectors only the k + 1 with the smallest ids can be
found, so where more rows than that share a vector the others are left out of the parts, whatever their number.

Vectors take no part if they are null, zero, of another length than most, or hold null or non-finite components; nor do
rows without an id. Ties go to the smaller id. A query never finds its own id; rows that repeat another id are found each. An id
is one query: where several rows share it, that whose vector has the least hash asks (then the lesser vector).
An empty table gives no rows. Columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

K = 20
QUERY_STEP = 20
SAMPLE_ROWS = 8192
CALIBRATION_QUERIES = 128
RECALL = 0.95
#: Rows in a part, aimed at; sampled rows that a part needs; rows from which on there are several parts.
PART_ROWS = 2048
PART_SAMPLE = 64
LEAST_ROWS = 200
#: A part is cut in turn into fewer parts than this, which numbers them.
MAX_PARTS = 256
BLOCK_ROWS = 8192
BLOCK_QUERIES = 16384
NEIGHBOURS = 12
HIDDEN = 96


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, embedding (array of doubles) of the rows that take part."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


# -- the sample: graph, cut, network ---------------------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node; ``parts`` is a power of two, part sizes differ by one at most for each bisection."""
    n, rng = len(graph), np.random.Generator(np.random.PCG64(seed))
    part = np.zeros(n, np.int64)
    for level in range(parts.bit_length() - 1):
        halves = part.copy()
        for p in range(1 << level):
            nodes = np.flatnonzero(part == p)
            halves[nodes] = 2 * p + _bisect(graph, nodes, rng)
        part = halves
    return part


def _bisect(graph: np.ndarray, nodes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    at = np.full(len(graph), -1, np.int64)
    at[nodes] = np.arange(len(nodes))
    to = at[graph[nodes]]
    a = np.repeat(np.arange(len(nodes)), to.shape[1])[to.ravel() >= 0]
    b = to.ravel()[to.ravel() >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    m = len(nodes)
    degree = np.bincount(a, minlength=m) + 1.0
    v = rng.standard_normal(m)
    for _ in range(60):
        v = (v + np.bincount(a, v[b], m) / degree) / 2
        v -= (v * degree).sum() / degree.sum()
        v /= np.abs(v).max() + 1e-30
    side = np.zeros(m, np.int64)
    side[np.argsort(v, kind="stable")[m // 2 :]] = 1
    for _ in range(30):  # swap the nodes that gain most on either side
        across = np.bincount(a, side[a] != side[b], m)
        gain = 2 * across - np.bincount(a, minlength=m)
        left, right = (np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1))
        q = min(len(left), len(right), max(1, m // 40))
        if not q:
            break
        cut = across.sum()
        left, right = left[np.argsort(-gain[left])[:q]], right[np.argsort(-gain[right])[:q]]
        side[left], side[right] = 1, 0
        if (side[a] != side[b]).sum() >= cut:
            side[left], side[right] = 0, 1
            break
    return side


class Router:
    """One hidden layer over vectors, a softmax over parts."""

    def __init__(self, layers: list[np.ndarray]):
        self.layers = layers

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x.astype(np.float32) @ w1 + b1, 0) @ w2 + b2

    @classmethod
    def train(cls, x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 5) -> Router:
        rng = np.random.Generator(np.random.PCG64(seed))
        scale = 1 / (np.sqrt((x**2).sum(1)).mean() + 1e-12)
        d, p = x.shape[1], target.shape[1]
        w = [rng.standard_normal((d, hidden)).astype(np.float32) * scale * 1.4, np.zeros(hidden, np.float32), rng.standard_normal((hidden, p)).astype(np.float32) * (2 / hidden) ** 0.5, np.zeros(p, np.float32)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        x, target = x.astype(np.float32), target.astype(np.float32)
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                q = np.exp(z - z.max(1, keepdims=True))
                dz = (q / q.sum(1, keepdims=True) - target[rows]) / len(rows)
                dh = (dz @ w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    g = g + 1e-5 * w[j]
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    w[j] -= 4e-3 * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return cls(w)


def fit_router(sample: np.ndarray, rows: int) -> Router | None:
    """The router for so many rows of which these are a sample; None if they are too few for parts."""
    parts = 4 if rows >= LEAST_ROWS and len(sample) > NEIGHBOURS + 4 else 1
    while 1 < parts < MAX_PARTS and parts * PART_ROWS < rows and parts * PART_SAMPLE < len(sample):
        parts *= 2
    if parts == 1:
        return None
    graph = neighbour_graph(sample.astype(np.float32), NEIGHBOURS)
    part = balanced_cut(graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(len(sample)), part] += 2
    return Router.train(sample, target / target.sum(1, keepdims=True))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Routers:
    """One router and, where parts are cut again, one for each of its parts: a few MB at most, whatever the table."""

    def __init__(self, top: Router | None, below: dict[int, Router] | None = None):
        self.top, self.below = top, below or {}
        n = 1 if top is None else top.layers[3].size
        self.parts = np.concatenate([p * MAX_PARTS + np.arange(self.below[p].layers[3].size if p in self.below else 1) for p in range(n)]).astype(np.int32)

    def assign(self, x: np.ndarray) -> np.ndarray:
        if self.top is None or not len(x):
            return np.zeros(len(x), np.int32)
        part = self.top.logits(x).argmax(1)
        out = part.astype(np.int32) * MAX_PARTS
        for p in np.unique(part).tolist():
            if p in self.below:
                rows = np.flatnonzero(part == p)
                out[rows] += self.below[p].logits(x[rows]).argmax(1).astype(np.int32)
        return out

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All parts, for each row from the most probable on."""
        if self.top is None:
            return np.zeros((len(x), 1), np.int32)
        out = []
        for a in range(0, len(x), 1024):
            top = _log_softmax(self.top.logits(x[a : a + 1024]))
            z = np.concatenate([top[:, p : p + 1] + (_log_softmax(self.below[p].logits(x[a : a + 1024])) if p in self.below else 0) for p in range(top.shape[1])], axis=1)
            out.append(self.parts[np.argsort(-z, axis=1, kind="stable")])
        return np.concatenate(out) if out else np.zeros((0, len(self.parts)), np.int32)


def fit_below(rows: DataFrame, top: Router, n: int, sample_rows: int) -> Routers:
    """Cuts each part of ``top`` again if the table has more rows than its parts should hold."""
    first = Routers(top)
    if len(first.parts) * PART_ROWS >= n:
        return first
    parts = assign(rows, first)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    least = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = parts.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= sample_rows).join(sizes, "part")

    def fit(group: pa.Table) -> pa.Table:
        router = fit_router(_matrix(group.column("embedding")), group.column("n")[0].as_py())
        layers = [] if router is None else [a.astype(np.float32).tobytes() for a in router.layers]
        return pa.table({"part": group.column("part")[:1], "layers": pa.array([layers], pa.list_(pa.binary()))})

    fitted = sample.groupBy("part").applyInArrow(fit, "part int, layers array<binary>").where(F.size("layers") > 0).collect()  # a row for each part of the first router
    below = {}
    for r in fitted:
        w1, b1, w2, b2 = (np.frombuffer(x, np.float32) for x in r["layers"])
        below[r["part"] // MAX_PARTS] = Router([w1.reshape(-1, len(b1)), b1, w2.reshape(len(b1), -1), b2])
    return Routers(top, below)


# -- index and search ------------------------------------------------------------------------------------------------


def assign(rows: DataFrame, routers: Routers) -> DataFrame:
    """Adds ``part`` to every row."""
    held = rows.sparkSession.sparkContext.broadcast(routers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.assign(_matrix(b.column(1))))], ["vec_id", "embedding", "part"])

    return rows.select("vec_id", "embedding").mapInArrow(work, "vec_id long, embedding array<double>, part int")


def _best(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best; exact ties go to the smaller id."""
    rows, found, scores = [], [], []
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        rough = q @ vectors.T
        rough[q_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            keep = rough >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None]
        else:
            keep = np.ones_like(rough, bool)
        i, j = np.nonzero(keep & np.isfinite(rough))
        s = (q[i] * vectors[j]).sum(axis=1)  # one order of summation for every pair, so equal vectors tie
        best = np.lexsort((ids[j], -s, i))
        i, j, s = i[best], j[best], s[best]
        start = np.searchsorted(i, np.arange(len(q)))
        top = np.arange(len(i)) - start[i] < k
        rows.append(i[top] + a)
        found.append(ids[j[top]])
        scores.append(s[top])
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return join(rows, np.int64), join(found, np.int64), join(scores, float)


class _Best:
    """The k best of each query over the tiles of a task, of which only they are passed on."""

    def __init__(self, k: int, most: int = 200_000):
        self.k, self.most, self.rows, self.n = k, most, [], 0

    def add(self, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(rows)
        self.n += len(rows[0])
        if self.n > self.most:
            self.merge()
            if self.n > self.most // 2:
                yield from self.flush()

    def merge(self) -> None:
        q, v, s = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < self.k
        self.rows, self.n = [(q[keep], v[keep], s[keep])], int(keep.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self.merge()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.rows[0]], FOUND[:3])
        self.rows, self.n = [], 0


FOUND = ["query_id", "vec_id", "score", "part"]
FOUND_DDL = "query_id long, vec_id long, score double, part int"


def brute_force(assigned: DataFrame, q_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The true k nearest of a bounded set of queries, over all rows, with the neighbours' parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, part = b.column(0).to_numpy(), b.column(2).to_numpy()
                i, found, s = _best(queries, q_ids, _matrix(b.column(1)), ids, k)
                by = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(found), pa.array(s), pa.array(part[by][np.searchsorted(ids[by], found)])], FOUND)

    return rank(assigned.mapInArrow(work, FOUND_DDL), k)


def rank(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def choose_probes(assigned: DataFrame, routers: Routers, sample: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> int:
    """How many parts a query must visit for the wanted recall, from brute force over all rows.

    ``sample`` holds ids and vectors of queries that the routers were not fitted on.
    """
    if len(routers.parts) == 1 or not len(sample[0]):
        return 1
    ids, vectors = sample
    truth = brute_force(assigned, ids, vectors, k).select("query_id", "part").toArrow()
    at = {int(q): i for i, q in enumerate(ids)}
    order = routers.ranked(vectors)
    place = [{p: i for i, p in enumerate(row)} for row in order.tolist()]
    needed = np.sort([place[at[q]][p] for q, p in zip(truth.column(0).to_pylist(), truth.column(1).to_pylist(), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def without_surplus(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be found: of more than k + 1 rows with equal vectors, those with the k + 1 smallest ids."""
    key = [F.xxhash64("embedding").alias("_h1"), F.xxhash64(F.lit(1), "embedding").alias("_h2")]
    slim = rows.select("vec_id", *key)
    often = common.pin(slim.groupBy("_h1", "_h2").count().where(F.col("count") > k + 1).select("_h1", "_h2"), "ann-often")
    if often.isEmpty():
        return rows
    nth = F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("vec_id"))
    ids = slim.join(often, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2", "vec_id").count()
    last = common.pin(ids.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("_h1", "_h2").agg(F.max("vec_id").alias("_last")), "ann-often")
    return rows.withColumns({"_h1": key[0], "_h2": key[1]}).join(last, ["_h1", "_h2"], "left").where("_last is null or vec_id <= _last").drop("_h1", "_h2", "_last")


def search(rows: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest others of each row for which ``is_query`` (of vec_id) holds."""
    rows = valid_vectors(rows)
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows + CALIBRATION_QUERIES).toArrow()
    n = rows.count()
    ids, vectors = sampled.column(0).to_numpy(), _matrix(sampled.column(1))
    # the first rows are kept out of the fit, equal ids as well
    held = np.isin(ids, ids[: min(CALIBRATION_QUERIES, len(ids) // 4)])
    top = fit_router(vectors[~held], n)
    unseen = rows.where(~F.col("vec_id").isin(*np.unique(ids[held]).tolist())) if held.any() else rows
    routers = Routers(None) if top is None else fit_below(unseen, top, n, sample_rows)
    assigned = common.pin(assign(rows, routers), "ann-parts")
    asks = np.unique(ids[held], return_index=True)[1]
    probes = choose_probes(assigned, routers, (ids[held][asks], vectors[held][asks]), k, recall)
    return visit(assigned, routers, is_query, probes, k)


def visit(assigned: DataFrame, routers: Routers, is_query: Column, probes: int, k: int) -> DataFrame:
    """The k best rows of the ``probes`` most probable parts of each query."""
    spark, at = assigned.sparkSession, assigned.sparkSession.sparkContext.broadcast(routers)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = at.value.ranked(_matrix(b.column(1)))[:, :probes]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["vec_id", "embedding", "parts"])

    asking = F.min(F.struct(F.xxhash64("embedding"), "embedding"))["embedding"].alias("embedding")  # one for each id
    asked_by = assigned.where(is_query).groupBy("vec_id").agg(asking)
    queries = common.pin(asked_by.mapInArrow(route, "vec_id long, embedding array<double>, parts array<int>"), "ann-queries")
    rows = without_surplus(assigned, k)
    # blocks of each part: a row for each, of which there are MAX_PARTS^2 at most
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in queries.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}
    blocks = spark.createDataFrame([(p, -(-n // BLOCK_ROWS), -(-asked[p] // BLOCK_QUERIES)) for p, n in sizes.items() if p in asked], "part int, n_c int, n_q int")
    block = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    key = ["part", "c", "q"]
    visits = queries.select("vec_id", "embedding", F.explode("parts").alias("part")).join(F.broadcast(blocks), "part")
    visits = visits.withColumn("q", block("n_q", 2)).withColumn("c", all_of("n_c")).withColumn("asks", F.lit(True))
    visited = rows.join(F.broadcast(blocks), "part").withColumn("c", block("n_c", 1)).withColumn("q", all_of("n_q")).withColumn("asks", F.lit(False))
    tiles = visits.unionByName(visited).drop("n_c", "n_q").repartition(*key).sortWithinPartitions(*key, "asks")  # rows before queries

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, best = None, [], None, _Best(k)
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "asks")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, e in zip(edges, edges[1:]):
                tile, part = tuple(keys[a, :3]), b.slice(a, e - a)
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))
                if tile != now:
                    now, held, block = tile, [], None
                if not keys[a, 3]:
                    held.append((ids, x))
                elif held:
                    block = block or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    i, found, s = _best(x, ids, block[1], block[0], k)
                    yield from best.add(ids[i], found, s)
        yield from best.flush()

    return rank(tiles.mapInArrow(scan, "query_id long, vec_id long, score double"), k).select(F.col("query_id"), "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
