"""Marts of the gold layer. Rows are unordered unless ``ordered`` asks for the order they are read in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import amount, mean, month_of, ratio

AMOUNTS = {"total_sales_amount": "item_total_amount", "total_product_sales_amount": "item_price", "total_freight_amount": "item_freight_value"}


def _by_order(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Items added up by order and ``keys``, where the fact already lies by order: a row for each, before any join or shuffle
    by the keys. Partial sums are exact decimals."""
    return rows.groupBy("order_id", *keys).agg(*[F.sum(amount(c)).alias(name) for name, c in AMOUNTS.items()], F.count("*").alias("item_count"), F.count("item_price").alias("price_count"))


def _sales(orders: DataFrame, *keys: str, customers: bool = True) -> DataFrame:
    """Amounts, item_count, order_count, customer_count and the count of prices, by ``keys``, of items added up by order.

    The filter passes every order that a distinct count counts. It has Spark count apart from the sums, so that no sums are
    shuffled with each order.
    """
    exact = {f"exact_{name}": F.sum(name) for name in AMOUNTS}
    return orders.groupBy(*keys).agg(
        *[F.round(e, 2).cast("double").alias(name) for name, e in zip(AMOUNTS, exact.values(), strict=True)], *[e.alias(name) for name, e in exact.items()],
        F.expr("count(DISTINCT order_id) FILTER (WHERE order_id IS NOT NULL)").alias("order_count"), F.sum("item_count").alias("item_count"),
        *([F.count_distinct("customer_id").alias("customer_count")] if customers else []), F.sum("price_count").alias("price_count"),
    )


def _in_order(rows: DataFrame, ordered: bool, *order: Column) -> DataFrame:
    return rows.orderBy(*order) if ordered else rows


def _is_net() -> Column:
    return (F.col("event_type") == "ORDER_CREATED") & ~F.col("order_status").eqNullSafe("canceled")


def net_of_cancellations(fact: DataFrame) -> DataFrame:
    """Each sold item once: creation events of orders that are not canceled (an unknown status is not)."""
    return fact.where(_is_net())


def daily_sales(fact: DataFrame, ordered: bool = False) -> DataFrame:
    """By day of the event, in order of days. All event types of an item count, as the source's mart has it; see
    :func:`net_of_cancellations` for the corrected input."""
    return _in_order(daily_columns(_sales(_by_order(fact, "order_event_date", "customer_id"), "order_event_date")), ordered, F.col("order_event_date"))


def daily_columns(sales: DataFrame, *others: str) -> DataFrame:
    """The mart's columns from amounts and counts by day, and ``others`` as they are."""
    return sales.select(
        "order_event_date", *AMOUNTS, "order_count", "item_count", "customer_count",
        ratio(F.col("total_sales_amount"), F.col("order_count"), 2).alias("avg_order_amount"), month_of("order_event_date").alias("order_month"), *others,
    )


def daily_sales_both(fact: DataFrame) -> DataFrame:
    """:func:`daily_sales` of all items and that of :func:`net_of_cancellations`, told apart by the column ``net``, from one pass
    over the fact: orders are added up with items that are net apart from others, and the net ones then count for both."""
    net = F.coalesce(_is_net(), F.lit(False)).alias("net")
    orders = _by_order(fact, "order_event_date", "customer_id", net)
    both = orders.withColumn("net", F.explode(F.when(F.col("net"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return daily_columns(_sales(both, "order_event_date", "net"), "net")


def category_sales(fact: DataFrame, dim_product: DataFrame, ordered: bool = False) -> DataFrame:
    """By category in English, the largest sales first; items of products that the dimension lacks have a null category,
    apart from unknown."""
    rows = _by_order(fact, "product_id").join(dim_product.select("product_id", "product_category_name_english"), "product_id", "left")
    return _in_order(category_columns(_sales(rows, "product_category_name_english", customers=False)), ordered, F.desc("total_sales_amount"), F.col("product_category_name_english"))


def category_columns(sales: DataFrame) -> DataFrame:
    """The mart's columns from amounts and counts by category."""
    return sales.select(
        "product_category_name_english", *AMOUNTS, "order_count", "item_count", ratio(F.col("exact_total_product_sales_amount"), F.col("price_count"), 2).alias("avg_item_price")
    )


def from_states(merged: DataFrame) -> DataFrame:
    """Merged states (:mod:`tidemark.operators.states`) as amounts and counts."""
    exact = {f"exact_{c}": F.col(c) for c in AMOUNTS}
    return merged.withColumns(exact).withColumns({c: F.round(F.col(c), 2).cast("double") for c in AMOUNTS})


def customer_segment_sales(fact: DataFrame, dim_customer: DataFrame, ordered: bool = False) -> DataFrame:
    """By age group, sex and occupation, the largest sales first."""
    keys = ["age_group", "sex", "occupation"]
    rows = _by_order(fact, "customer_id").join(dim_customer.select("customer_id", *keys), "customer_id", "left")
    made = _sales(rows, *keys).select(*keys, *AMOUNTS, "order_count", "customer_count", "item_count", ratio(F.col("total_sales_amount"), F.col("customer_count"), 2).alias("avg_customer_amount"))
    return _in_order(made, ordered, F.desc("total_sales_amount"), *map(F.col, keys))


def delivery_kpi(fact: DataFrame, ordered: bool = False) -> DataFrame:
    """By day of the delivery event, in order of days."""
    made = fact.groupBy("delivery_event_date").agg(
        F.count("*").alias("delivery_event_count"), F.count_if(F.col("event_type") == "DELIVERY_COMPLETED").alias("completed_delivery_count"),
        F.count_if("is_delayed").alias("delayed_delivery_count"), mean("shipping_days").alias("avg_days_to_carrier"), mean("delivery_days").alias("avg_total_delivery_days"),
    )
    made = made.withColumns({"delay_rate": ratio(F.col("delayed_delivery_count"), F.col("delivery_event_count"), 4), "delivery_month": month_of("delivery_event_date")})
    return _in_order(made, ordered, F.col("delivery_event_date"))


def review_kpi(fact: DataFrame, ordered: bool = False) -> DataFrame:
    """By day of the review event, in order of days."""
    scores = [F.count_if(F.col("review_score") == s).alias(f"score_{s}_count") for s in range(1, 6)]
    made = fact.groupBy("review_event_date").agg(F.count("*").alias("review_count"), mean("review_score").alias("avg_review_score"), *scores, mean("review_answer_days").alias("avg_review_answer_days"))
    return _in_order(made.withColumn("review_month", month_of("review_event_date")), ordered, F.col("review_event_date"))
