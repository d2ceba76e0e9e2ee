"""A topic as one query: deduplicated events, late events, per-minute counts and totals from a single pass over each batch.

Where two queries a topic have a state each, here a batch is deduplicated once and written to all
sinks, each idempotent by the batch's number (:mod:`tidemark.streaming.batches`): a batch that runs again after a failure
writes the same rows to the same folders.

State is a table as well: the ids of events that may still repeat, with their times. An id is known for as long as a repeat can
arrive in time: until the watermark, the latest time of earlier batches less the delay, has passed its time by the delay; then a
fold drops it. Events behind the watermark are *routed* to a table of late events, so every valid event is in exactly one
of: events, late, repeats of those. Without a delay nothing is late and ids are known for ever.

Counts are of each batch alone and are added up on reading. A fold of counts adds them up and moves windows that have left the
retention into a sum for each event type, so the table is bounded while totals stay those of all events.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.events import TOPICS
from tidemark.streaming import batches
from tidemark.streaming.jobs import RETENTION, WATERMARK, minute_counts, topic_events

SEEN = "event_id string, event_time timestamp"
COUNTS = "window_start timestamp, window_end timestamp, event_type string, event_count long"
#: Latest event time of a batch, and of all before it.
CLOCK = "latest timestamp"


def schema_of(topic: str) -> str:
    return ", ".join(f"{f.name} {'timestamp' if f.name == 'event_time' else 'string'}" for f in TOPICS[topic])


def _once(batch: DataFrame) -> DataFrame:
    """Of events that repeat within the batch the first by time, then by all fields."""
    others = sorted(c for c in batch.columns if c not in ("event_id", "event_time"))
    order = Window.partitionBy("event_id").orderBy("event_time", *others)
    return batch.withColumn("nth_event", F.row_number().over(order)).where("nth_event = 1").drop("nth_event")


def _clock(spark: SparkSession, root: str, before: int):
    """The latest event time of batches before this one."""
    return batches.read(spark, f"{root}/clock", CLOCK, before - 1).agg(F.max("latest")).first()[0]


def write_batch(batch: DataFrame, batch_id: int, root: str, delay: str | None = WATERMARK, fold_every: int = batches.FOLD_EVERY, retention: str = RETENTION, schema: str = "") -> None:
    """One batch of valid events to ``events``, ``late``, ``counts`` and the state below ``root``."""
    spark = batch.sparkSession
    clock = _clock(spark, root, batch_id)
    mark = F.lit(None).cast("timestamp") if clock is None or delay is None else F.lit(clock) - F.expr(f"INTERVAL {delay}")
    held = batch.withColumn("is_late", F.coalesce(F.col("event_time") < mark, F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = batches.read(spark, f"{root}/seen", SEEN, batch_id - 1).select("event_id")
        late, timely = (held.where(F.col("is_late") == flag).drop("is_late") for flag in (True, False))
        fresh = _once(timely).join(known, "event_id", "left_anti").select(*batch.columns).persist(StorageLevel.MEMORY_AND_DISK)
        batches.write(fresh.select("event_id", "event_time"), f"{root}/seen", batch_id)
        batches.write(late, f"{root}/late", batch_id)
        batches.write(minute_counts(fresh), f"{root}/counts", batch_id)
        batches.write(held.agg(F.max("event_time").alias("latest")), f"{root}/clock", batch_id)
        batches.write(fresh, f"{root}/events", batch_id)
        fresh.unpersist()
    finally:
        held.unpersist()
    if batch_id % fold_every == fold_every - 1:
        fold_topic(spark, root, batch_id, delay, retention, schema)


def fold_topic(spark: SparkSession, root: str, upto: int, delay: str | None, retention: str, schema: str) -> None:
    """Compact events and late events, forget ids that cannot repeat in time, move old windows into the carried totals."""
    clock = _clock(spark, root, upto + 1)

    def live_ids(rows: DataFrame) -> DataFrame:
        return rows if delay is None or clock is None else rows.where(F.col("event_time") >= F.lit(clock) - F.expr(f"INTERVAL {delay}") - F.expr(f"INTERVAL {delay}"))

    for name, ddl, change in (("events", schema, None), ("late", schema, None), ("seen", SEEN, live_ids), ("clock", CLOCK, lambda r: r.agg(F.max("latest").alias("latest"))), ("counts", COUNTS, lambda r: carried(r, retention))):
        batches.fold(spark, f"{root}/{name}", ddl, upto, change)


def carried(counts: DataFrame, retention: str) -> DataFrame:
    """Counts added up by window; windows before the retention become one row for each event type, without a window."""
    last = counts.agg((F.max("window_start") - F.expr(retention)).alias("kept_from"))
    rows = counts.join(F.broadcast(last), how="left")  # one row
    old = F.col("window_start") < F.col("kept_from")
    window = [F.when(~old, F.col(c)).alias(c) for c in ("window_start", "window_end")]
    return rows.select(*window, "event_type", "event_count").groupBy("window_start", "window_end", "event_type").agg(F.sum("event_count").alias("event_count"))


def read_events(spark: SparkSession, root: str, topic: str, name: str = "events") -> DataFrame:
    """The ``events`` of a topic, or those that came ``late``."""
    return batches.read(spark, f"{root}/{name}", schema_of(topic)).drop("batch_id")


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """The windows that are kept."""
    rows = batches.read(spark, f"{root}/counts", COUNTS).where("window_start is not null")
    return rows.groupBy("window_start", "window_end", "event_type").agg(F.sum("event_count").alias("event_count"))


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    """All events of each type, those of windows that are no longer kept too."""
    return batches.read(spark, f"{root}/counts", COUNTS).groupBy("event_type").agg(F.sum("event_count").alias("total_count"))


def start(messages: DataFrame, topic: str, root: str, delay: str | None = WATERMARK, fold_every: int = batches.FOLD_EVERY, retention: str = RETENTION, **trigger) -> StreamingQuery:
    """The query of a topic; it goes on where it stopped, with the state of its checkpoint and tables."""
    return start_events(topic_events(messages, topic), schema_of(topic), root, delay, fold_every, retention, **trigger)


def start_events(events: DataFrame, schema: str, root: str, delay: str | None = WATERMARK, fold_every: int = batches.FOLD_EVERY, retention: str = RETENTION, **trigger) -> StreamingQuery:
    save = lambda batch, batch_id: write_batch(batch, batch_id, root, delay, fold_every, retention, schema)
    return events.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(save).trigger(**trigger).start()
