"""Structured Streaming jobs: sources, parsing, deduplication, the bronze sink, per-window metrics and their totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import event_time_text
from tidemark.operators.events import TOPICS, demux, parse_envelope, require_fields
from tidemark.sources.readers import read_or_empty
from tidemark.sources.sinks import remove

WATERMARK = "2 minutes"
RETENTION = "INTERVAL 24 HOURS"


def kafka_source(spark: SparkSession, servers: str, topics: list[str], starting: str = "earliest", **options: str) -> DataFrame:
    """Messages of some topics, from the first; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting).options(**options).load()


def file_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", files_per_batch: int | None = None, **options: str) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def topic_events(messages: DataFrame, topic: str) -> DataFrame:
    """The valid events of one topic."""
    return require_fields(parse_envelope(demux(messages, topic), TOPICS[topic]))


def dedup(events: DataFrame, watermark: str | None = WATERMARK, keys: tuple[str, ...] = ("event_id",), time: str = "event_time") -> DataFrame:
    """Each event once within the watermark delay, after which its state goes. Rows later than that are dropped.

    Without a watermark nothing is dropped as late, and nothing is deduplicated.
    """
    return events if watermark is None else events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def minute_counts(events: DataFrame, time: str = "event_time", width: str = "1 minute") -> DataFrame:
    """Events of each type in tumbling windows; for batches and streams alike."""
    counted = events.groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("event_count"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "event_count")


def write_bronze(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


#: Batches after which the metric directories are folded.
FOLD_EVERY = 256
_WINDOW = ["window_start", "window_end", "event_type"]


def write_metrics(counts: DataFrame, path: str, checkpoint: str, fold_every: int = FOLD_EVERY, **trigger) -> StreamingQuery:
    """Window counts in update mode, a directory for each batch; a batch that runs again replaces its own.

    Every ``fold_every`` batches the directories are folded into one table, so there are never more than twice as many.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id % fold_every == fold_every - 1:
            fold_metrics(batch.sparkSession, path, batch_id)

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**trigger).start()


def _folds(spark: SparkSession, path: str) -> list[int]:
    """The batches up to which folds are complete, ascending."""
    return sorted({r["upto"] for r in read_or_empty(spark, f"{path}_folds", "upto long").collect()})


def _metric_rows(spark: SparkSession, path: str, folds: list[int]) -> DataFrame:
    """The last complete fold and the batches after it."""
    rows = spark.read.parquet(path)
    if not folds:
        return rows
    return rows.where(F.col("batch_id") > folds[-1]).unionByName(spark.read.parquet(f"{path}_folded/upto={folds[-1]}"))


def fold_metrics(spark: SparkSession, path: str, upto: int) -> None:
    """Write the current counts up to a batch as one table, note that it is complete, and remove what the fold before made
    superfluous: whoever reads meanwhile still finds the files of the fold before."""
    folds = [f for f in _folds(spark, path) if f < upto]
    rows = _metric_rows(spark, path, folds).where(F.col("batch_id") <= upto)
    folded = rows.groupBy(*_WINDOW).agg(F.max_by("event_count", "batch_id").alias("event_count"), F.max("batch_id").alias("batch_id"))
    folded.write.mode("overwrite").parquet(f"{path}_folded/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}_folds")
    if folds:
        remove(spark, *[f"{path}_folded/upto={f}" for f in folds[:-1]], *[f"{path}/batch_id={i}" for i in range(folds[-2] + 1 if len(folds) > 1 else 0, folds[-1] + 1)])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The current count of each window: that of its latest batch. Counts are cumulative and never added up."""
    rows = _metric_rows(spark, path, _folds(spark, path))
    return rows.groupBy(*_WINDOW).agg(F.max_by("event_count", "batch_id").alias("event_count"))


def metric_keys(metrics: DataFrame, prefix: str = "metrics") -> DataFrame:
    """Text keys and counts as a key/value store holds them: prefix:timeseries:type:start for each window, prefix:latest:type
    for each type's last window and prefix:total:type for all of its events."""
    key = lambda *parts: F.concat_ws(":", F.lit(prefix), *parts).alias("key")
    series = metrics.select(key(F.lit("timeseries"), F.col("event_type"), event_time_text("window_start")), "event_count")
    latest = latest_window(metrics).select(key(F.lit("latest"), F.col("event_type")), "event_count")
    return series.unionByName(latest).unionByName(totals(metrics).select(key(F.lit("total"), F.col("event_type")), F.col("total_count").alias("event_count")))


def totals(metrics: DataFrame) -> DataFrame:
    """All events of each type, from the current counts."""
    return metrics.groupBy("event_type").agg(F.sum("event_count").alias("total_count"))


def latest_window(metrics: DataFrame) -> DataFrame:
    """The last window of each event type, by its start."""
    last = metrics.groupBy("event_type").agg(F.max_by(F.struct("window_start", "window_end", "event_count"), "window_start").alias("w"))
    return last.select("event_type", "w.*")


def retained_series(metrics: DataFrame, retention: str = RETENTION) -> DataFrame:
    """Windows that start within the retention before the last one, in event time."""
    last = metrics.agg((F.max("window_start") - F.expr(retention)).alias("_from"))
    return metrics.join(F.broadcast(last), F.col("window_start") >= F.col("_from")).drop("_from")  # one row


def write_totals(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Running totals by event type, kept in state; each batch writes them anew as one file beside those of the batch before."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")  # a row for each event type
        remove(batch.sparkSession, f"{path}/batch_id={batch_id - 2}")

    counted = events.groupBy("event_type").agg(F.count("*").alias("total_count"))
    return counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**trigger).start()


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last batch."""
    rows = spark.read.parquet(path)
    return rows.groupBy("event_type").agg(F.max_by("total_count", "batch_id").alias("total_count"))


def route_topics_json(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Messages as JSON lines, a folder for each topic."""
    rows = messages.select(F.col("topic"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return rows.writeStream.format("json").partitionBy("topic").outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def start_topic(messages: DataFrame, topic: str, root: str, watermark: str | None = WATERMARK, **trigger) -> list[StreamingQuery]:
    """The two queries of a topic: its events to bronze, its counts to metrics, with a checkpoint each."""
    events = dedup(topic_events(messages, topic), watermark)
    return [
        write_bronze(events, f"{root}/bronze/{topic}", f"{root}/checkpoints/{topic}/bronze", **trigger),
        write_metrics(minute_counts(events), f"{root}/metrics/{topic}", f"{root}/checkpoints/{topic}/metrics", **trigger),
    ]


def run(spark: SparkSession, start: Callable[[], list[StreamingQuery]], wait_any: bool = False) -> None:
    """Start queries and wait: for all of them (with availableNow), or until any ends. A failure is raised."""
    started = start()
    if wait_any:
        spark.streams.awaitAnyTermination()
        return
    for q in started:
        q.awaitTermination()
