"""Marts from stored states that add up: an increment is aggregated once and never read again.

The state of an increment has, for each group of a mart, exact sums, and the distinct orders and customers as bitmaps over
dense ids: bit positions in buckets of 32,768, so states merge by OR and a count is the number of bits. Bitmaps are of built-in
aggregates; a row holds 4 KB at most, and a group with many members is many rows, never one.

Dense ids come from a dictionary beside the states: new keys are numbered on from the last one, in the order of a row
index, so keys that arrive together share buckets. The dictionary has a bucketed index, like a fact, by which a load joins: the
keys of earlier loads are read but not shuffled. A load writes its states below its own number, which a mark names when
they are complete; a load that runs again replaces what it left.

Groups that hang on a dimension (category, segment) are those of the dimension when the increment was loaded. Null orders
and customers are not counted, as a distinct count has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import amount
from tidemark.operators.incremental import KeyIndex, buckets_of
from tidemark.operators.indexing import with_row_index
from tidemark.operators.marts import AMOUNTS
from tidemark.sources.readers import read_or_empty
from tidemark.sources.sinks import remove

COUNTED = {"order_count": "order_id", "customer_count": "customer_id"}


def dense_ids(keys: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """(key, id), bucketed by key, for every distinct key of a one-column table that is not null; those not in the dictionary at
    ``path`` are added. One writer at a time."""
    spark, name, schema = keys.sparkSession, keys.columns[0], "key string, id long"
    key, number = T.StructField("key", T.StringType()), T.StructField("id", T.LongType())
    index = KeyIndex(spark, path, T.StructType([key]), buckets or buckets_of(spark), T.StructType([number]))
    known = read_or_empty(spark, path, schema)
    index.ready(known)
    last = known.agg(F.max("id")).first()[0]
    fresh = keys.select(F.col(name).cast("string").alias("key")).dropna().distinct().join(index.table(), "key", "left_anti")
    made = with_row_index(fresh, "key", name="nth").select("key", (F.col("nth") + (last or 0)).alias("id"))  # pinned, so it outlives the append
    index.begin()
    made.write.mode("append").parquet(path)
    index.add(made)
    index.done()
    index.merge_if_many(lambda: read_or_empty(spark, path, schema))
    return index.table()


def sales_states(rows: DataFrame, groups: list[str], ids: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The states of some fact rows: sums by group, and (group, counted, bucket, bits)."""
    sums = rows.groupBy(*groups).agg(*[F.sum(amount(c)).alias(name) for name, c in AMOUNTS.items()], F.count("*").alias("item_count"), F.count("item_price").alias("price_count"))
    bits = None
    for name, column in COUNTED.items():
        member = rows.select(*groups, F.col(column).cast("string").alias("key")).dropna(subset=["key"]).distinct().join(ids[column], "key")
        part = member.groupBy(*groups, F.lit(name).alias("counted"), F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        bits = part if bits is None else bits.unionByName(part)
    return sums, bits


def add_states(rows: DataFrame, groups: list[str], path: str, load: int, ids: dict[str, DataFrame]) -> None:
    """Store the states of load number ``load``; rows are those that it added to the fact."""
    spark = rows.sparkSession
    for name, table in zip(("sums", "bits"), sales_states(rows, groups, ids), strict=True):
        remove(spark, f"{path}/{name}/load={load}")
        table.write.parquet(f"{path}/{name}/load={load}")
    spark.createDataFrame([(load,)], "load long").coalesce(1).write.mode("append").parquet(f"{path}/done")


def merged(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """Groups with their exact sums and distinct counts over all complete loads."""
    done = [r["load"] for r in read_or_empty(spark, f"{path}/done", "load long").distinct().collect()]  # a row for each load
    sums, bits = (spark.read.parquet(f"{path}/{name}").where(F.col("load").isin(*done)) for name in ("sums", "bits"))
    keys = lambda df: [F.col(f"{df}.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    whole = sums.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in (*AMOUNTS, "item_count", "price_count")])
    sizes = bits.groupBy(*groups, "counted", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counted = sizes.groupBy(*groups).agg(*[F.coalesce(F.sum(F.when(F.col("counted") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTED])
    joined = whole.alias("s").join(counted.alias("c"), keys("c"), "left")
    return joined.select("s.*", *[F.coalesce(F.col(f"c.{c}"), F.lit(0)).alias(c) for c in COUNTED])
