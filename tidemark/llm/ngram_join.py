"""Self-join of texts on the Jaccard similarity of their word n-grams, by MinHash banding with exact verification.

1. Each text becomes its set of hashed n-grams (lower-cased words), a MinHash signature and its band hashes. Texts with
   equal sets form one class; everything after works on classes, so copies are never expanded.
2. Classes that share a band hash form a bucket. Buckets with the same members in several bands count once.
3. A bucket is cut into blocks of bounded size, and each pair of its blocks is a tile. A tile receives the full n-gram sets
   of its members and verifies all their pairs at once (sparse set products), counting a pair only in the first band
   that both share. It returns counts and the edges of a spanning forest: no pair ever becomes a row.
4. Components of the forest edges are found by alternating star contractions, pinned after each round.

The number of rows in a band, and of bands, follow from the threshold and the recall asked for: at the threshold itself a
pair is found with that probability, above it with more. What is found is exact: every link was verified on full sets.

Texts of fewer words than an n-gram have one, of all their words; texts without words have their own text as the only one.
A null text is an empty one. Null ids are kept and are never a class id unless the whole class has none. Repeated rows are
copies of each other, and of rows with the least id and one text the one that stays is chosen by a hash of all its columns.
An empty table gives no rows. :func:`join_ngrams` reads the id and the text alone; :func:`drop_near_copies` keeps all columns,
whatever their names. Cost beyond the shuffle of band hashes grows with what is similar: a bucket of m different texts costs
m^2/2 comparisons, spread over tiles.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.words import chained, held

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
#: A block of a bucket holds about so many n-grams, and texts, at most.
BLOCK_NGRAMS = 1 << 20
BLOCK_TEXTS = 1024
_WORD = re.compile(r"\w+")
_CACHE = 1 << 17
_LAST = (1 << 63) - 1


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``max_hashes`` that finds a pair at the threshold with ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches this recall")
    return best


class _WordHash(dict):
    """word -> a hash of it; the words of late, and as many older ones."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, word: str) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= _CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = h
        return h


def word_hashes() -> _WordHash:
    return held("word hashes", _WordHash)


def ngrams(text: str, n: int, hashes: _WordHash | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    hashes = word_hashes() if hashes is None else hashes
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([hashes["\x00" + text]], np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = chained(x, h[i : len(h) - k + 1 + i])
    return np.unique(x)


def _signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value under each of the permutations; in slices that fit the cache."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 256):
        np.minimum(low, (sets[i : i + 256, None] * a + b).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, row_hash, set_id, n_ngrams and the band hashes of each text."""
    rng = np.random.Generator(np.random.PCG64(7))
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, hashes = [], [], []
            words = word_hashes()
            for text in batch.column(3):
                s = ngrams(text.as_py(), n, words)
                x = np.full(bands, rows, np.uint64)
                for column in _signature(s, a, b).reshape(bands, rows).T:
                    x = chained(x, column)
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                hashes.append(x.view(np.int64))
            flat = pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_hash", "row_hash", "set_id", "n_ngrams", "bands"])

    return _keyed(docs).mapInArrow(sign, "doc_id long, text_hash long, row_hash long, set_id binary, n_ngrams long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), common.row_hash(docs).alias("row_hash"), text.alias("text"))


def _members(classes: DataFrame) -> DataFrame:
    """Rows of (bucket, set_id, block, other): who takes part in which tile. Buckets have two different sets at least."""
    spread = classes.select("set_id", "n_ngrams", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        spread.groupBy("band", "hash")
        .agg(F.count("*").alias("n"), F.sum("n_ngrams").alias("weight"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"))
        .where("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("band", "hash", "weight")).alias("b"))
        .select("b.band", "b.hash", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("b.weight") / BLOCK_NGRAMS), F.lit(1)).cast("int").alias("blocks"))
    )
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("set_id", "hash"), F.col("blocks")).cast("int")).otherwise(0)
    return (
        spread.join(buckets, ["band", "hash"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("set_id", "band", "hash", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
    )


def _verify(rows: dict, band: int, first: int, second: int, threshold: float) -> list[tuple[bytes, int, int, bytes]]:
    """Links of one tile: (set, linked documents, linked sets, root of the set within the tile's forest)."""
    keep = list({k: i for i, k in enumerate(rows["set_id"])}.values())
    ids, sets, copies = ([rows[c][i] for i in keep] for c in ("set_id", "ngrams", "copies"))
    bands, block = np.array([rows["bands"][i] for i in keep]), np.array([rows["block"][i] for i in keep])
    m, sizes, weights = len(ids), np.array([len(s) for s in sets]), np.array(copies, np.int64)
    if m < 2:
        return []
    wanted = np.triu(np.ones((m, m), bool), 1) & (bands[:, band][:, None] == bands[:, band][None, :])
    if first != second:
        wanted &= block[:, None] != block[None, :]
    for j in range(band):  # counted there
        wanted &= bands[:, j][:, None] != bands[:, j][None, :]
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    wanted &= low >= threshold * high - 1e-9
    pairs = np.argwhere(wanted)
    if not len(pairs):
        return []
    if len(pairs) <= 8 * m:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    else:
        owner = np.repeat(np.arange(m), sizes)
        _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.flatnonzero(seen[at] > 1)
        common_id = np.cumsum(seen > 1) - 1
        at, owner = common_id[at[order]], owner[order]
        by = np.argsort(at, kind="stable")
        at, owner = at[by], owner[by]
        both = np.zeros((m, m), np.float32)
        for c in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            a, b = np.searchsorted(at, [c, c + 4096])
            grid = np.zeros((m, 4096), np.float32)
            grid[owner[a:b], at[a:b] - c] = 1
            both += grid @ grid.T  # whole numbers below 2^24: exact
        shared = both[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    total = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - shared
    links = pairs[shared >= threshold * total - 1e-9]
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    documents, texts = np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.add.at(documents, links[:, 0], weights[links[:, 1]])
    np.add.at(documents, links[:, 1], weights[links[:, 0]])
    np.add.at(texts, links.ravel(), 1)
    for i, j in links.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
    return [(ids[i], int(documents[i]), int(texts[i]), ids[find(i)]) for i in range(m) if texts[i]]


def _tiles(members: DataFrame, classes: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Verified links of all tiles; the n-gram sets are made anew from the texts of the classes that take part."""
    members = common.pin(members, "join-members")
    needed = classes.join(members.select("set_id").distinct(), "set_id", "left_semi").select("set_id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"), F.col("rep.row_hash").alias("row_hash"), "copies", "bands")
    keyed = _keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    texts = keyed.join(needed, ["doc_id", "text_hash", "row_hash"]).select("set_id", "copies", "bands", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_hashes()
            grams = pa.array([ngrams(t.as_py(), n, words).view(np.int64) for t in batch.column(3)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), grams], ["set_id", "copies", "bands", "ngrams"])

    sets = texts.mapInArrow(expand, "set_id binary, copies long, bands array<long>, ngrams array<long>")
    key = ["band", "hash", "first", "second"]
    rows = members.join(sets, "set_id").repartition(*key).sortWithinPartitions(*key)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, {}, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            flat, ends = batch.column("ngrams").values.to_numpy(), batch.column("ngrams").offsets.to_numpy()
            other = {c: batch.column(c).to_pylist() for c in ("set_id", "copies", "block")}
            bands = batch.column("bands").values.to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else []
            for i, k in enumerate(keys):
                if k != now:
                    if now:
                        found += _verify(held, now[0], now[2], now[3], threshold)
                    now, held = k, {c: [] for c in ("set_id", "copies", "block", "ngrams", "bands")}
                for c, v in other.items():
                    held[c].append(v[i])
                held["ngrams"].append(flat[ends[i] : ends[i + 1]].copy())
                held["bands"].append(bands[i].copy())
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), LINK_TYPES, strict=True)], LINK_NAMES)
                found = []
        if now:
            found += _verify(held, now[0], now[2], now[3], threshold)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), LINK_TYPES, strict=True)], LINK_NAMES)

    return common.pin(rows.mapInArrow(verify, "set_id binary, documents long, texts long, root binary"), "join-links")


LINK_NAMES = ["set_id", "documents", "texts", "root"]
LINK_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node it is connected to) for the nodes of undirected edges (a, b).

    Alternating star contractions: each node's neighbours are tied to its least neighbour, until every component is a
    star. Minima are map-side aggregates, pinned so that they meet the edges in a join of their own, which adaptive
    execution splits where a hub has many edges.
    """
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = common.pin(ordered(edges), "components")
    seen = state(edges)
    while seen[0]:
        before = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = common.pin(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-low")
        large = common.pin(ordered(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "components-large")
        least = common.pin(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = common.pin(ordered(small), "components")
        common.unpin(before, low, large, least)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def join_ngrams(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, text_hash, row_hash, copy_id, class_id, n_links, n_text_links, kept.

    ``copy_id`` is the least id among the texts with an equal n-gram set, ``class_id`` that of the component of links,
    ``n_links`` counts the other documents that the join links with this one, ``n_text_links`` the different sets among them.
    ``kept`` names the (id, text hash, row hash) of the class's one document that stays.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = common.pin(signatures(docs, n, bands, rows), "join-signatures")
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text_hash", "row_hash")).alias("rep")
    classes = common.pin(signed.groupBy("set_id").agg(rep, F.count("*").alias("copies"), F.first("n_ngrams").alias("n_ngrams"), F.first("bands").alias("bands")), "join-classes")
    links = _tiles(_members(classes), classes, docs, n, threshold)
    label = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_id").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    info = (
        classes.select("set_id", "rep", "copies")
        .join(counts, "set_id", "left")
        .join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
        .withColumn("label", F.coalesce("label", "set_id"))
    )
    info = common.pin(info, "join-info")
    kept = common.pin(info.groupBy("label").agg(F.min("rep").alias("kept")), "join-kept")  # pinned: a large class can be split in the join
    info = info.join(kept, "label").select("set_id", "rep", "copies", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("texts", F.lit(0)).alias("texts"), "kept")
    name = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return signed.select("doc_id", "text_hash", "row_hash", "set_id").join(common.pin(info, "join-info"), "set_id").select(
        "doc_id", "text_hash", "row_hash", name("rep.doc_id").alias("copy_id"), name("kept.doc_id").alias("class_id"),
        (F.col("documents") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"), "kept",
    )


def drop_near_copies(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without near copies: of each class the one with the least id stays, with all its columns."""
    columns, key = docs.columns, [common.free_name(docs, x) for x in ("id", "text_hash", "row_hash")]
    keyed = docs.withColumns(dict(zip(key, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(common.text_or_empty("text")), common.row_hash(docs)), strict=True)))
    with common.temporary(docs.sparkSession) as scope:
        kept = join_ngrams(docs, n, threshold, recall).select("kept").distinct().select("kept.*")
        kept = scope.keep(common.pin(kept.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "text_hash", "row_hash"), key, strict=True)]), "join-kept"))
    # rows alike in all columns have the same key, and one of them is enough
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(common.table(spark, sf_dir, "documents")).drop("text_hash", "row_hash", "kept")
