"""Event streams out of the commerce tables: generation, envelopes, parsing, validation and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import event_time_text, first_filled, free_name, key_hash

_text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
ORDER_SCHEMA = _text("event_id", "event_type", "event_time", "order_id", "customer_id", "order_status")
#: What producers write and what consumers expect, together; a field that is missing reads as null.
DELIVERY_SCHEMA = _text("event_id", "event_type", "event_time", "order_id", "customer_id", "order_status", "order_estimated_delivery_date", "delivery_status")
REVIEW_SCHEMA = _text("event_id", "event_type", "event_time", "review_id", "order_id", "customer_id", "review_score")
TOPICS = {"order-events": ORDER_SCHEMA, "delivery-events": DELIVERY_SCHEMA, "review-events": REVIEW_SCHEMA}
REQUIRED = ("event_id", "event_time", "event_type")


def _events(df: DataFrame, kinds: list[tuple[str, Column, Column]], key: str, *fields: str) -> DataFrame:
    """One row for each kind whose condition and time hold, in a single pass. kinds: (type, condition, time), by priority.

    Kinds that do not hold are left out after the explode: leaving them out of the array takes a function that is not compiled.
    """
    found = F.array(*[
        F.when(condition & time.isNotNull(), F.struct(F.lit(kind).alias("event_type"), time.alias("at"), F.lit(i).alias("priority")))
        for i, (kind, condition, time) in enumerate(kinds, 1)
    ])
    event = free_name(df, "event")
    rows = df.withColumn(event, F.explode(found)).where(F.col(event).isNotNull())
    return rows.select(
        F.concat(f"{event}.event_type", F.lit("_"), key).alias("event_id"), f"{event}.event_type",
        event_time_text(f"{event}.at").alias("event_time"), *fields, F.col(f"{event}.priority").alias("priority"),
    )


def order_events(orders: DataFrame, ordered: bool = False) -> DataFrame:
    """Created, approved and canceled orders. The cancellation comes 60 to 3599 seconds, by a hash of the order, after the
    approval, or the purchase without one."""
    zero = F.lit(0)
    delay = F.make_interval(zero, zero, zero, zero, zero, zero, (F.lit(60) + key_hash("order_id") % 3540).cast("decimal(18,6)"))
    purchased, approved, always = F.col("order_purchase_timestamp"), F.col("order_approved_at"), F.lit(True)
    canceled = (F.col("order_status") == "canceled") & purchased.isNotNull()
    kinds = [("ORDER_CREATED", always, purchased), ("ORDER_APPROVED", always, approved), ("ORDER_CANCELED", canceled, F.coalesce(approved, purchased) + delay)]
    rows = _events(orders, kinds, "order_id", "order_id", "customer_id", "order_status")
    return (rows.orderBy("event_time", "priority", "event_id") if ordered else rows).drop("priority")


def delivery_events(orders: DataFrame, ordered: bool = False) -> DataFrame:
    """Started and completed deliveries of orders that are not canceled; an unknown status is not canceled."""
    kept = orders.where(~F.col("order_status").eqNullSafe("canceled")).withColumn("order_estimated_delivery_date", event_time_text("order_estimated_delivery_date"))
    kinds = [("DELIVERY_STARTED", F.lit(True), F.col("order_delivered_carrier_date")), ("DELIVERY_COMPLETED", F.lit(True), F.col("order_delivered_customer_date"))]
    rows = _events(kept, kinds, "order_id", "order_id", "customer_id", "order_status", "order_estimated_delivery_date")
    return (rows.orderBy("event_time", "event_id") if ordered else rows).drop("priority")


def review_events(reviews: DataFrame, orders: DataFrame, ordered: bool = False) -> DataFrame:
    """Reviews with the customer of their order."""
    rows = reviews.join(orders.select("order_id", "customer_id"), "order_id", "left")
    rows = _events(rows, [("REVIEW_CREATED", F.lit(True), F.col("review_creation_date"))], "review_id", "review_id", "order_id", "customer_id", F.col("review_score").cast("string").alias("review_score"))
    return (rows.orderBy("event_time", "event_id") if ordered else rows).drop("priority")


def timeline(*streams: DataFrame) -> DataFrame:
    """All events in one table; fields that a stream lacks are null. The order is (event_time, event_id): sort on read."""
    merged = streams[0]
    for s in streams[1:]:
        merged = merged.unionByName(s, allowMissingColumns=True)
    return merged


def event_key() -> Column:
    """What a message is partitioned by: the order, else the review, else the event."""
    return first_filled("order_id", "review_id", "event_id")


def to_envelope(df: DataFrame, topic: str) -> DataFrame:
    """Messages of (topic, key, value) with the event as JSON text; nulls are left out."""
    names = df.columns
    key = first_filled(*[n for n in ("order_id", "review_id", "event_id") if n in names])
    return df.select(F.lit(topic).alias("topic"), key.alias("key"), F.to_json(F.struct(*names)).alias("value"))


def demux(messages: DataFrame, topic: str) -> DataFrame:
    return messages.where(F.col("topic") == topic)


def parse_envelope(messages: DataFrame, schema: T.StructType, ntz: bool = False) -> DataFrame:
    """The events in ``value``; fields outside the schema are dropped, the text NaN and unreadable times become null."""
    rows = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")
    clean = {f.name: F.when(~F.trim(F.col(f.name), F.lit('"')).eqNullSafe("NaN"), F.col(f.name)).alias(f.name) for f in schema}
    clean["event_time"] = F.col("event_time").try_cast("timestamp_ntz" if ntz else "timestamp")
    return rows.withColumns(clean)


def require_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names or REQUIRED))


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key: the first in the given order, which should leave no ties."""
    nth = free_name(df, "nth")
    numbered = df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(nth) == 1).drop(nth)
