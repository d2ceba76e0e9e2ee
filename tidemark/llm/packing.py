"""Packing into optimal length buckets.

The histogram of all lengths is aggregated by Spark. Dynamic programming over it chooses at most ``buckets`` boundaries for
which padding every document to its bucket's boundary costs least (with the lower hull of lines it takes time linear in
the histogram for each bucket). Inside a bucket documents form batches of as many as fit ``budget`` tokens once padded;
a document longer than the budget has a batch of its own.

The histogram has a row for each length up to 65,536. Longer ones fall into cells of 1/32,768 of their size at most, so it
has a bounded number of rows whatever the corpus (65,536, and as many for each doubling beyond, of which those that occur
count): there boundaries are optimal among cells, which pads a document by 0.003 % of its length at most.

Places within a bucket come from a hash order, or from the order of files and of rows in them where these are given: ranges of
it are counted, the counts accumulated over a small table, and rows numbered within their range, so a bucket with most of the
documents is no single task's work.

Null and empty texts have length 0 or what the length column gives them; they are packed too. Repeated rows and null ids
are packed row by row, rows of equal hash in the order they are read; where a key (or none) has more rows than a range should
hold, they are spread over the ranges by a hash of their place. An empty table gives no rows. Other columns are left
as they are, but a column of the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.tokens import n_tokens

BUCKETS = 16
BUDGET = 1 << 16
RANGE_ROWS = 4096
_EXACT = 1 << 16


def cell(length: Column) -> Column:
    """The upper end of the histogram cell of a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(_EXACT)).cast("double"))) - 15)
    return F.when(length <= _EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def optimal_boundaries(histogram: Iterable[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Boundaries, ascending, that pad the counted lengths least; the last is the greatest length."""
    rows = sorted((int(a), int(n)) for a, n in histogram if n > 0)
    if not rows:
        return []
    lengths, m = [a for a, _ in rows], len(rows)
    upto = [0]
    for _, n in rows:
        upto.append(upto[-1] + n)
    # best[j]: least padded size of the first j lengths in k buckets; the next layer is the lower envelope of lines in length
    best, choice = [0] + [lengths[j] * upto[j + 1] for j in range(m)], []
    for _ in range(1, min(buckets, m)):
        hull: list[int] = []  # candidates i with slope -upto[i] and intercept best[i]
        after, cut, head = best[:], [0] * (m + 1), 0
        for j in range(1, m + 1):
            i = j - 1
            while len(hull) - head >= 2 and _above(hull[-2], hull[-1], i, upto, best):
                hull.pop()
            hull.append(i)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and best[hull[head + 1]] - x * upto[hull[head + 1]] <= best[hull[head]] - x * upto[hull[head]]:
                head += 1
            cut[j] = hull[head]
            after[j] = best[hull[head]] + x * (upto[j] - upto[hull[head]])
        choice.append(cut)
        best = after
    found, j = [], m
    for cut in reversed(choice):
        found.append(lengths[j - 1])
        j = cut[j]
        if j == 0:
            break
    if j:
        found.append(lengths[j - 1])
    return found[::-1]


def _above(a: int, b: int, c: int, upto: list[int], best: list[int]) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (best[c] - best[a]) * (upto[b] - upto[a]) <= (best[b] - best[a]) * (upto[c] - upto[a])


def pack(rows: DataFrame, length: str, key: list[str], buckets: int = BUCKETS, budget: int = BUDGET, place: list[str] | None = None) -> DataFrame:
    """Adds ``bucket, bucket_tokens, batch, slot`` to rows with an integer ``length`` column.

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the rows of a batch. ``key`` orders rows, by its hash, unless ``place``
    does: columns of which the last counts rows from 0. Rows should be a pinned table: they are read twice, once for the
    histogram.
    """
    results = ["bucket", "bucket_tokens", "batch", "slot"]
    columns = [c for c in rows.columns if c.lower() not in results]
    cell_, bucket, hash_, copy, span, nth, before, often = (common.free_name(rows, x, *results) for x in ("cell", "bucket", "hash", "copy", "range", "nth", "before", "often"))
    size = F.coalesce(F.col(length), F.lit(0)).cast("long")
    sized = rows.withColumn(cell_, cell(size))
    histogram = [tuple(r) for r in sized.groupBy(cell_).count().collect()]
    bounds = optimal_boundaries(histogram, buckets)
    counts = [sum(n for a, n in histogram if low < a <= high) for low, high in zip([-1, *bounds], bounds)]
    if not bounds:
        bounds, counts = [0], [0]
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(bucket) + 1)
    # the boundary of each bucket, an array of at most `buckets`
    placed = sized.withColumn(bucket, F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(cell_))))
    placed = placed.withColumn(copy, F.monotonically_increasing_id())
    hashed = F.xxhash64(*key)
    if place is None:
        many = common.pin(rows.groupBy(F.xxhash64(*key).alias(hash_)).count().where(F.col("count") > RANGE_ROWS).select(hash_, F.lit(True).alias(often)), "pack-often")
        if not many.isEmpty():
            placed = placed.withColumn(hash_, hashed).join(many, hash_, "left")
            hashed = F.when(F.col(often), F.xxhash64(hash_, copy)).otherwise(F.col(hash_))
    placed = placed.withColumn(hash_, hashed)
    unit = F.shiftrightunsigned(F.xxhash64(hash_, F.lit(3)), 11).cast("double") / float(1 << 53)
    if place is None:
        ranged, order = F.struct(F.floor(unit * pick([max(1, -(-n // RANGE_ROWS)) for n in counts])).cast("int")), [hash_, *key]
    else:
        ranged, order = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if t == "string" else F.coalesce(c, F.lit(-1)) for c, t in rows.select(*place[:-1]).dtypes], F.floor(F.col(place[-1]) / RANGE_ROWS)), place
    placed = placed.withColumn(span, ranged)
    running = Window.partitionBy(bucket).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy(bucket, span).count().select(bucket, span, F.coalesce(F.sum("count").over(running), F.lit(0)).alias(before))
    within = Window.partitionBy(bucket, span).orderBy(*order, copy)
    at = F.col(before) + F.col(nth) - 1
    capacity = pick([max(1, budget // max(1, b)) for b in bounds])
    made = [F.col(bucket).alias("bucket"), pick(bounds).alias("bucket_tokens"), F.floor(at / capacity).cast("long").alias("batch"), (at % capacity).cast("int").alias("slot")]
    return placed.withColumn(nth, F.row_number().over(within)).join(earlier, [bucket, span]).select(*columns, *made)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pack(common.pin(docs.select("doc_id", (n_tokens() + 1).alias("n_tokens")), "pack-lengths"), "n_tokens", ["doc_id"])
