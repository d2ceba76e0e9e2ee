"""The lake's batch run as one application: ingest, dimensions, incremental facts, checks, marts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dims, events, facts, incremental, marts, quality
from tidemark.sources import readers, sinks


@dataclass(frozen=True)
class SourceSpec:
    """Where a raw table is and how it is read; ``timestamps`` are columns to coerce."""

    path: str
    format: str = "csv"
    schema: str | None = None
    timestamps: tuple[str, ...] = field(default=())


def ingest_raw(spark: SparkSession, specs: Mapping[str, SourceSpec], root: str) -> None:
    """Raw files to bronze Parquet, each by its own format."""
    for name, spec in specs.items():
        if spec.format == "csv":
            df = readers.read_csv(spark, spec.path, spec.schema)
        else:
            df = readers.read_table(spark, spec.path) if spec.format == "parquet" else spark.read.format(spec.format).load(spec.path)
        sinks.overwrite(readers.coerce_timestamps(df, *spec.timestamps), f"{root}/bronze/{name}")


def build_dims(spark: SparkSession, root: str) -> None:
    read = lambda name: readers.read_table(spark, f"{root}/bronze/{name}")
    sinks.overwrite(dims.dim_customer(read("customers"), read("personas")), f"{root}/silver/dim_customer")
    sinks.overwrite(dims.dim_product(read("products"), read("category_translation")), f"{root}/silver/dim_product")
    sinks.overwrite(dims.dim_seller(read("sellers")), f"{root}/silver/dim_seller")


def load_facts(spark: SparkSession, root: str) -> dict[str, int]:
    """Append what the event logs have beyond the facts; returns the rows added to each."""
    read = lambda name: readers.read_table(spark, f"{root}/bronze/{name}")
    log = lambda topic: events.require_fields(readers.read_table(spark, f"{root}/bronze/{topic}"))
    plans = {
        "fact_order_item": (lambda: facts.fact_order_item(log("order-events"), read("order_items"), read("payments")), facts.ITEM_KEY, "order_month"),
        "fact_delivery": (lambda: facts.fact_delivery(log("delivery-events"), read("orders")), facts.DELIVERY_KEY, "delivery_month"),
        "fact_review": (lambda: facts.fact_review(log("review-events"), read("reviews")), facts.REVIEW_KEY, "review_month"),
    }
    return {name: incremental.load_fact(spark, make(), f"{root}/silver/{name}", keys, month) for name, (make, keys, month) in plans.items()}


def check_silver(spark: SparkSession, root: str) -> DataFrame:
    """The profile of the silver tables; raises on empty tables and on null or repeated keys, so that gold is not built."""
    keys = {
        "dim_customer": ["customer_id"], "dim_product": ["product_id"], "dim_seller": ["seller_id"],
        "fact_order_item": facts.ITEM_KEY, "fact_delivery": facts.DELIVERY_KEY, "fact_review": facts.REVIEW_KEY,
    }
    profiles = events.timeline(*[quality.profile(n, readers.read_table(spark, f"{root}/silver/{n}"), k) for n, k in keys.items()])
    quality.check(profiles)
    return profiles


def build_marts(spark: SparkSession, root: str, to_database: Callable[[DataFrame, str], None] | None = None) -> None:
    """Each mart once: kept on disk while it is written to the lake and, if wanted, to a database."""
    read = lambda name: readers.read_table(spark, f"{root}/silver/{name}")
    items = read("fact_order_item")
    made = {
        "mart_daily_sales": (marts.daily_sales(items), "order_month"),
        "mart_category_sales": (marts.category_sales(items, read("dim_product")), None),
        "mart_customer_segment_sales": (marts.customer_segment_sales(items, read("dim_customer")), None),
        "mart_delivery_kpi": (marts.delivery_kpi(read("fact_delivery")), "delivery_month"),
        "mart_review_kpi": (marts.review_kpi(read("fact_review")), "review_month"),
    }
    for name, (mart, month) in made.items():
        kept = mart.persist(StorageLevel.DISK_ONLY)
        try:
            sinks.overwrite(kept, f"{root}/gold/{name}", month)
            if to_database:
                to_database(kept, name)
        finally:
            kept.unpersist()


def run(spark: SparkSession, root: str, to_database: Callable[[DataFrame, str], None] | None = None) -> dict[str, int]:
    """Dimensions, facts, checks, marts; a failed check stops the run before gold."""
    build_dims(spark, root)
    added = load_facts(spark, root)
    check_silver(spark, root)
    build_marts(spark, root, to_database)
    return added


def months(df: DataFrame, month: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of a range of months; a filter on the partition column, so other months are not read."""
    if first is not None:
        df = df.where(F.col(month) >= first)
    return df.where(F.col(month) <= last) if last is not None else df
