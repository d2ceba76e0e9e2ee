"""A dense row index over a sorted table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import free_name
from tidemark.session import scratch


def with_row_index(df: DataFrame, *order: str, name: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """Adds ``name``, 1 to n in the given order (which should have no ties).

    Rows are ranged over partitions by the key; the range of each row is pinned with the table in the shared folder, so
    the second pass numbers the same ranges even if executors are lost. Rows are then numbered within their range, and
    the sizes of the ranges before it, one row for each, are added.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "row-index")
    range_, nth, before = (free_name(df, stem, name) for stem in ("range", "nth", "before"))
    df.repartitionByRange(parts, *order).withColumn(range_, F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    earlier = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(range_).agg(F.count("*").alias("n")).select(range_, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    numbered = ranged.withColumn(nth, F.row_number().over(Window.partitionBy(range_).orderBy(*order))).join(F.broadcast(starts), range_)
    return numbered.withColumn(name, (F.col(before) + F.col(nth)).cast("long")).select(*df.columns, name)
