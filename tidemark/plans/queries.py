"""The registered queries: each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dims, events, facts, incremental, indexing, marts, quality, sampling, states
from tidemark.session import scratch
from tidemark.sources import bindings as b
from tidemark.sources import readers, sinks
from tidemark.streaming import jobs, topics

#: What the incremental queries take as loaded already: facts of months before this one.
LOADED_BEFORE = "1998-01"
EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.col("event_time").try_cast("timestamp_ntz"))


def order_events(s: SparkSession, d: str) -> DataFrame:
    return events.order_events(b.orders(s, d))


def delivery_events(s: SparkSession, d: str) -> DataFrame:
    return events.delivery_events(b.orders(s, d))


def review_events(s: SparkSession, d: str) -> DataFrame:
    return events.review_events(b.reviews(s, d), b.orders(s, d))


def event_timeline(s: SparkSession, d: str) -> DataFrame:
    merged = events.timeline(order_events(s, d), delivery_events(s, d), review_events(s, d))
    return indexing.with_row_index(merged, "event_time", "event_id", name="position").select("position", "event_id", "event_type", "event_time", "order_id", "customer_id", "review_id")


def event_key(s: SparkSession, d: str) -> DataFrame:
    merged = events.timeline(order_events(s, d), delivery_events(s, d), review_events(s, d))
    return merged.select("event_id", events.event_key().alias("event_key"))


def parse_events_json(s: SparkSession, d: str) -> DataFrame:
    messages = events.timeline(events.to_envelope(order_events(s, d), "order-events"), events.to_envelope(review_events(s, d), "review-events"))
    return events.parse_envelope(events.demux(messages, "order-events"), events.ORDER_SCHEMA, ntz=True)


def events_valid(s: SparkSession, d: str) -> DataFrame:
    """The events table as messages, of which every seventh is cut short and every eleventh has no readable time."""
    rows = b.raw(s, d, "events")
    time = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", time.alias("event_time"), F.col("user_id").cast("string").alias("customer_id")))
    value = F.when(F.col("event_id") % 7 == 0, F.substring(text, F.lit(1), F.length(text) - 12)).otherwise(text)
    messages = rows.select(F.lit("order-events").alias("topic"), value.alias("value"))
    return events.require_fields(events.parse_envelope(messages, events.ORDER_SCHEMA, ntz=True)).select("event_id", "event_type", "event_time", "customer_id")


def dedup_events(s: SparkSession, d: str) -> DataFrame:
    """Every order event twice, once an hour late: the earlier stays."""
    once = _timed(order_events(s, d))
    late = once.withColumn("event_time", F.col("event_time") + F.expr("interval 1 hour"))
    return events.first_per_key(late.unionByName(once), ["order_id", "event_type"], "event_time", "event_id")


def dim_seller(s: SparkSession, d: str) -> DataFrame:
    return dims.dim_seller(b.sellers(s, d))


def dim_product(s: SparkSession, d: str) -> DataFrame:
    return dims.dim_product(b.products(s, d), b.category_translation(s))


def dim_customer(s: SparkSession, d: str) -> DataFrame:
    return dims.dim_customer(b.customers(s, d), b.personas(s, d))


def row_index_orders(s: SparkSession, d: str) -> DataFrame:
    rows = b.orders(s, d).select("order_id", "order_purchase_timestamp")
    return indexing.with_row_index(rows, "order_purchase_timestamp", "order_id").select("order_id", "row_idx")


def payments_total(s: SparkSession, d: str) -> DataFrame:
    return facts.payments_total(b.payments(s, d))


def fact_order_item(s: SparkSession, d: str) -> DataFrame:
    return facts.fact_order_item(_timed(order_events(s, d)), b.order_items(s, d), b.payments(s, d))


def fact_delivery(s: SparkSession, d: str) -> DataFrame:
    return facts.fact_delivery(_timed(delivery_events(s, d)), b.orders(s, d))


def fact_review(s: SparkSession, d: str) -> DataFrame:
    return facts.fact_review(_timed(review_events(s, d)), b.reviews(s, d))


def _increment(fact: DataFrame, keys: list[str], month: str, within: str | None = None) -> DataFrame:
    return incremental.new_rows(fact, fact.where(F.col(month) < LOADED_BEFORE), keys, within)


def incr_order_item(s: SparkSession, d: str) -> DataFrame:
    return _increment(fact_order_item(s, d), facts.ITEM_KEY, "order_month", "order_id")


def incr_delivery(s: SparkSession, d: str) -> DataFrame:
    return _increment(fact_delivery(s, d), facts.DELIVERY_KEY, "delivery_month")


def incr_review(s: SparkSession, d: str) -> DataFrame:
    return _increment(fact_review(s, d), facts.REVIEW_KEY, "review_month")


def mart_daily_sales(s: SparkSession, d: str) -> DataFrame:
    return marts.daily_sales(fact_order_item(s, d))


def mart_daily_sales_net(s: SparkSession, d: str) -> DataFrame:
    return marts.daily_sales(marts.net_of_cancellations(fact_order_item(s, d)))


def mart_category_sales(s: SparkSession, d: str) -> DataFrame:
    return marts.category_sales(fact_order_item(s, d), dim_product(s, d))


def mart_customer_segment_sales(s: SparkSession, d: str) -> DataFrame:
    return marts.customer_segment_sales(fact_order_item(s, d), dim_customer(s, d))


def mart_delivery_kpi(s: SparkSession, d: str) -> DataFrame:
    return marts.delivery_kpi(fact_delivery(s, d))


def mart_review_kpi(s: SparkSession, d: str) -> DataFrame:
    return marts.review_kpi(fact_review(s, d))


def minute_counts(s: SparkSession, d: str) -> DataFrame:
    return jobs.minute_counts(b.raw(s, d, "events"), "ts")


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.file_source(s, d, EVENTS_DDL, "parquet", pathGlobFilter="events.parquet")
    return rows.withColumn("event_time", F.col("ts").cast("timestamp"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s, "metrics")
    jobs.run(s, lambda: [jobs.write_metrics(jobs.minute_counts(_event_stream(s, d)), f"{root}/metrics", f"{root}/checkpoint", availableNow=True)])
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return jobs.read_metrics(s, f"{root}/metrics").withColumns(ntz)


def stream_minute_counts(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d)


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """Events delivered twice and out of order, each kept once; the watermark spans the whole log."""
    root = scratch(s, "dedup")
    twice = _event_stream(s, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = jobs.dedup(twice, "400 days").select("event_id", "event_type", "user_id", "ts")
    jobs.run(s, lambda: [jobs.write_bronze(once, f"{root}/bronze", f"{root}/checkpoint", availableNow=True)])
    return s.read.parquet(f"{root}/bronze")


def stream_totals(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s, "totals")
    jobs.run(s, lambda: [jobs.write_totals(_event_stream(s, d), f"{root}/totals", f"{root}/checkpoint", availableNow=True)])
    return jobs.read_totals(s, f"{root}/totals")


def latest_window(s: SparkSession, d: str) -> DataFrame:
    return jobs.latest_window(_metrics(s, d))


def series_retention(s: SparkSession, d: str) -> DataFrame:
    return jobs.retained_series(_metrics(s, d))


def persona_age_group(s: SparkSession, d: str) -> DataFrame:
    return b.personas(s, d).select("persona_id", "age", "age_group")


def persona_name(s: SparkSession, d: str) -> DataFrame:
    return b.personas(s, d).select("persona_id", "customer_name")


def persona_by_sex(s: SparkSession, d: str) -> DataFrame:
    return b.personas(s, d).groupBy("sex").agg(F.count("*").alias("persona_count"))


def persona_age_share(s: SparkSession, d: str) -> DataFrame:
    return sampling.shares(b.personas(s, d), "age_group")


def persona_quota_sample(s: SparkSession, d: str) -> DataFrame:
    """As many draws as there are personas, by the fixed age ratios."""
    people = b.personas(s, d)
    return sampling.quota_sample(people, "age_group", "persona_id", sampling.quotas(people.count())).select("age_group", "slot", "persona_id", "customer_name")


def persona_shuffle(s: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(b.personas(s, d), "persona_id").select("position", "persona_id")


def silver_profile(s: SparkSession, d: str) -> DataFrame:
    tables = {
        "dim_customer": (dim_customer, ["customer_id"]), "dim_product": (dim_product, ["product_id"]), "dim_seller": (dim_seller, ["seller_id"]),
        "fact_order_item": (fact_order_item, facts.ITEM_KEY), "fact_delivery": (fact_delivery, facts.DELIVERY_KEY), "fact_review": (fact_review, facts.REVIEW_KEY),
    }
    return events.timeline(*[quality.profile(name, f(s, d), keys) for name, (f, keys) in tables.items()])


def mart_daily_sales_ordered(s: SparkSession, d: str) -> DataFrame:
    """The mart in its reading order, with the place of each row."""
    return indexing.with_row_index(mart_daily_sales(s, d), "order_event_date", name="position")


def mart_category_sales_ordered(s: SparkSession, d: str) -> DataFrame:
    return indexing.with_row_index(mart_category_sales(s, d), F.desc("total_sales_amount"), "product_category_name_english", name="position")


def mart_segment_sales_ordered(s: SparkSession, d: str) -> DataFrame:
    return indexing.with_row_index(mart_customer_segment_sales(s, d), F.desc("total_sales_amount"), "age_group", "sex", "occupation", name="position")


def metric_keys(s: SparkSession, d: str) -> DataFrame:
    return jobs.metric_keys(_metrics(s, d))


def orders_head(s: SparkSession, d: str) -> DataFrame:
    """The first hundred orders: a limit is what the operator is for."""
    return quality.sample(b.orders(s, d).orderBy("order_purchase_timestamp", "order_id"), 100)


def orders_from_csv(s: SparkSession, d: str) -> DataFrame:
    """The orders by way of CSV text, whose timestamps are read leniently."""
    path, rows = scratch(s, "orders-csv"), b.orders(s, d)
    times = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"]
    rows.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in times else F.col(c) for c in rows.columns]).write.option("header", True).csv(path)
    return readers.coerce_timestamps(readers.read_csv(s, path, ", ".join(f"{c} string" for c in rows.columns)), *times)


def events_from_jsonl(s: SparkSession, d: str) -> DataFrame:
    """The order events by way of JSON lines."""
    path = scratch(s, "events-jsonl")
    sinks.write_jsonl(order_events(s, d), path)
    return readers.read_event_jsonl(s, path, events.ORDER_SCHEMA)


def persona_normalized(s: SparkSession, d: str) -> DataFrame:
    """Personas as they are published, with other column names and the age as text."""
    rows = b.personas(s, d).select("persona_id", F.col("sex").alias("gender"), F.col("age").cast("string").alias("age"), F.col("persona").alias("professional_persona"))
    return sampling.normalize_persona(rows, "professional_persona").select("persona_id", "sex", "age", "age_group", "customer_name", "persona")


def loaded_order_item(s: SparkSession, d: str) -> DataFrame:
    """The item fact after two loads, the second of which brings all rows again, read back by month."""
    path, fact = f"{scratch(s, 'loaded')}/fact", fact_order_item(s, d)
    for rows in (fact.where(F.col("order_month") < LOADED_BEFORE), fact):
        incremental.load_fact(s, rows, path, facts.ITEM_KEY, "order_month", within="order_id")
    return readers.read_table(s, path)


def replaced_daily_sales(s: SparkSession, d: str) -> DataFrame:
    """The daily mart, written over the one net of cancellations and read back. Both come from one pass over the fact."""
    root = scratch(s, "replaced")
    path = f"{root}/mart"
    marts.daily_sales_both(fact_order_item(s, d)).write.parquet(f"{root}/both")
    for net in (True, False):
        sinks.overwrite(s.read.parquet(f"{root}/both").where(F.col("net") == net).drop("net"), path, "order_month")
    return readers.read_table(s, path)


def _stated(s: SparkSession, d: str, groups: list[str], with_groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups from the states of two increments of the item fact, which is computed once."""
    root, used = scratch(s, "states"), ("order_id", "customer_id", "product_id", "order_event_date", *marts.AMOUNTS.values())
    second = ~F.coalesce(F.col("order_month") < LOADED_BEFORE, F.lit(False))
    fact_order_item(s, d).select(*used, second.cast("int").alias("increment")).write.parquet(f"{root}/increments")
    for load in range(2):
        rows = s.read.parquet(f"{root}/increments").where(F.col("increment") == load).drop("increment")
        ids = {c: states.dense_ids(rows.select(c), f"{root}/ids-{c}") for c in states.COUNTED.values()}
        states.add_states(with_groups(rows), groups, f"{root}/states", load, ids)
    return marts.from_states(states.merged(s, f"{root}/states", groups))


def mart_daily_sales_stated(s: SparkSession, d: str) -> DataFrame:
    return marts.daily_columns(_stated(s, d, ["order_event_date"], lambda rows: rows))


def mart_category_sales_stated(s: SparkSession, d: str) -> DataFrame:
    products = dim_product(s, d).select("product_id", "product_category_name_english")
    return marts.category_columns(_stated(s, d, ["product_category_name_english"], lambda rows: rows.join(products, "product_id", "left")))


def order_events_ordered(s: SparkSession, d: str) -> DataFrame:
    """Order events with their place by time and, where times tie, by the priority of their type."""
    priority = F.create_map(*[F.lit(x) for pair in (("ORDER_CREATED", 1), ("ORDER_APPROVED", 2), ("ORDER_CANCELED", 3)) for x in pair])
    rows = order_events(s, d).withColumn("priority", priority[F.col("event_type")])
    return indexing.with_row_index(rows, "event_time", "priority", "event_id", name="position").drop("priority")


def routed_topics(s: SparkSession, d: str) -> DataFrame:
    """Three topics of messages routed to JSON lines by a stream, read back."""
    root = scratch(s, "routed")
    made = [events.to_envelope(f(s, d), topic) for f, topic in ((order_events, "order-events"), (delivery_events, "delivery-events"), (review_events, "review-events"))]
    events.timeline(*made).write.parquet(f"{root}/in")  # one job, so that no topic waits for the last task of another
    stream = jobs.file_source(s, f"{root}/in", "topic string, key string, value string", "parquet")
    jobs.run(s, lambda: [jobs.route_topics_json(stream, f"{root}/out", f"{root}/checkpoint", availableNow=True)])
    back = s.read.schema("topic string, key string, value string").json(f"{root}/out")
    return back.select("topic", "key", F.get_json_object("value", "$.event_id").alias("event_id"))


def _days(s: SparkSession, d: str) -> DataFrame:
    """The events with the number of their day, of which each also brings the first minutes of the day before again."""
    rows = b.raw(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").cast("string").alias("customer_id"))
    day, minute = F.dayofyear("event_time"), F.hour("event_time") * 60 + F.minute("event_time")
    again = rows.where(minute < 120).withColumn("nth", day + 1)
    return rows.withColumn("nth", day).unionByName(again)


_DAYS = "event_id string, event_type string, event_time timestamp, customer_id string"


def _topic(s: SparkSession, d: str, delay: str | None) -> str:
    """One query over a stream of batches of eight days and what they repeat, with a fold every second batch, started again
    for each batch and once more when it has ended. All files that a start finds are one batch, so all tasks write and read them."""
    root, dealt = scratch(s, "topic"), _days(s, d)

    def go_on() -> None:
        stream = jobs.file_source(s, f"{root}/in/*", _DAYS, "parquet")
        jobs.run(s, lambda: [topics.start_events(stream, _DAYS, f"{root}/topic", delay, 2, availableNow=True)])

    for i in range(0, 33, 8):
        dealt.where(F.col("nth").between(i, i + 7)).drop("nth").write.parquet(f"{root}/in/batch={i // 8}")
        go_on()
    go_on()  # finds nothing new and must change nothing
    return f"{root}/topic"


def late_events(s: SparkSession, d: str) -> DataFrame:
    """Events in time and late ones, each kind once: late are those an hour behind the latest time of the batches before."""
    root = _topic(s, d, "1 hour")
    parts = [topics.batches.read(s, f"{root}/{name}", _DAYS).select("event_id", "event_type", F.lit(name).alias("kind")) for name in ("events", "late")]
    return parts[0].unionByName(parts[1]).distinct()


def topic_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of a topic without a delay, whose repeats are dropped and whose old windows are carried."""
    return topics.read_totals(s, _topic(s, d, None))


def topic_series(s: SparkSession, d: str) -> DataFrame:
    """The windows that the same topic keeps, of the last 24 hours."""
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return jobs.retained_series(topics.read_counts(s, _topic(s, d, None))).withColumns(ntz)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        order_events, delivery_events, review_events, event_timeline, event_key, parse_events_json, events_valid, dedup_events, dim_seller,
        dim_product, dim_customer, row_index_orders, payments_total, fact_order_item, fact_delivery, fact_review, incr_order_item,
        incr_delivery, incr_review, mart_daily_sales, mart_daily_sales_net, mart_category_sales, mart_customer_segment_sales,
        mart_delivery_kpi, mart_review_kpi, minute_counts, stream_minute_counts, stream_dedup, stream_totals, latest_window,
        series_retention, persona_age_group, persona_name, persona_by_sex, persona_age_share, persona_quota_sample, persona_shuffle, silver_profile,
        mart_daily_sales_ordered, mart_category_sales_ordered, mart_segment_sales_ordered, metric_keys, loaded_order_item, replaced_daily_sales, mart_daily_sales_stated,
        mart_category_sales_stated, order_events_ordered, routed_topics, late_events, topic_totals, topic_series, orders_head, orders_from_csv, events_from_jsonl, persona_normalized,
    )
}
