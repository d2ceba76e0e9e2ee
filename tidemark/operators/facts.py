"""Facts of the silver layer. Each takes parsed events (with a real event_time) and bronze tables and is a pure function;
which rows are new is the business of :mod:`tidemark.operators.incremental`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import month_of, timestamp_or_null, total
from tidemark.operators.events import first_per_key

ITEM_KEY = ["order_id", "order_item_id", "event_type"]
DELIVERY_KEY = ["order_id", "event_type"]
REVIEW_KEY = ["review_id", "event_type"]


def _dated(c: str, prefix: str) -> tuple[Column, Column]:
    day = F.to_date(c)
    return day.alias(f"{prefix}_event_date"), month_of(day).alias(f"{prefix}_month")


def payments_total(payments: DataFrame) -> DataFrame:
    """What was paid for each order, in all its payments."""
    return payments.groupBy("order_id").agg(total("payment_value", None).alias("payment_total_value"))


def fact_order_item(order_events: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Each item once for each type of event its order had.

    Of repeated events the first counts, of repeated items the one least by its other columns. Orders without items have
    no rows; orders without payments have a null total (per order: never sum it over items).

    Events and items are dealt by order once; what is first of a key, the joins and aggregates by order that follow all hold there.
    """
    events = first_per_key(order_events.repartition("order_id"), ["order_id", "event_type"], "event_time", "event_id")
    unique = first_per_key(items.repartition("order_id"), ["order_id", "order_item_id"], "shipping_limit_date", "product_id", "seller_id", "price", "freight_value")
    joined = events.join(unique, "order_id").join(payments_total(payments), "order_id", "left")
    return joined.select(
        *ITEM_KEY[:2], "customer_id", "product_id", "seller_id", "event_type", "event_time", "order_status", "shipping_limit_date",
        F.col("price").alias("item_price"), F.col("freight_value").alias("item_freight_value"), (F.col("price") + F.col("freight_value")).alias("item_total_amount"),
        "payment_total_value", *_dated("event_time", "order"),
    )


def fact_delivery(delivery_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivery events with the dates of their order. Of repeated orders the first by purchase counts.

    The status is that of the event, else the type says whether the delivery started or completed.
    """
    times = [c for c in orders.columns if c in ("order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")]
    known = first_per_key(orders.select("order_id", *[timestamp_or_null(c, ntz=True).alias(c) for c in times]), ["order_id"], *times)
    events = first_per_key(delivery_events, DELIVERY_KEY, "event_time", "event_id")
    implied = F.when(F.col("event_type") == "DELIVERY_STARTED", "started").when(F.col("event_type") == "DELIVERY_COMPLETED", "completed")
    given = F.col("delivery_status") if "delivery_status" in events.columns else F.lit(None).cast("string")
    arrived, promised, bought = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date"), F.col("order_purchase_timestamp")
    return events.withColumn("delivery_status", F.coalesce(given, implied)).select("order_id", "customer_id", "event_type", "event_time", "delivery_status").join(known, "order_id", "left").select(
        "order_id", "customer_id", "event_type", "event_time", "delivery_status", *times,
        F.date_diff("order_delivered_carrier_date", bought).alias("shipping_days"), F.date_diff(arrived, bought).alias("delivery_days"),
        arrived.isNotNull().alias("is_delivered"), F.coalesce(arrived > promised, F.lit(False)).alias("is_delayed"), *_dated("event_time", "delivery"),
    )


def fact_review(review_events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review events with the days until the answer. Of repeated reviews the first by creation and answer counts."""
    times = reviews.select("review_id", *[timestamp_or_null(c, ntz=True).alias(c) for c in ("review_creation_date", "review_answer_timestamp")])
    known = first_per_key(times, ["review_id"], "review_creation_date", "review_answer_timestamp")
    events = first_per_key(review_events, REVIEW_KEY, "event_time", "event_id").select("review_id", "order_id", "customer_id", "event_type", "event_time", F.col("review_score").try_cast("int").alias("review_score"))
    return events.join(known, "review_id", "left").select(
        "review_id", "order_id", "customer_id", "event_type", "event_time", "review_score", "review_answer_timestamp",
        F.date_diff("review_answer_timestamp", "review_creation_date").alias("review_answer_days"), *_dated("event_time", "review"),
    )
