"""Streams against their batch twins, over one and many batches, restarts, late and repeated events."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators import events
from tidemark.plans import queries
from tidemark.streaming import batches, jobs, topics

ENVELOPE = "topic string, key string, value string"


def _message(event_id, minute, kind="ORDER_CREATED", topic="order-events"):
    value = json.dumps({"event_id": event_id, "event_type": kind, "event_time": f"2018-01-01 00:{minute:02d}:30", "order_id": event_id})
    return json.dumps({"topic": topic, "key": event_id, "value": value}) + "\n"


def _write(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(lines))
    at = 1_500_000_000 + 60 * int(name.split(".")[0])  # files are read in order of their times
    os.utime(path / name, (at, at))


def test_topic_over_batches_and_a_restart(spark, folder, tmp_path):
    source = tmp_path / "in"
    _write(source, "1.json", _message("a", 1), _message("b", 1), _message("b", 1), "\n")

    def go():
        messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE, files_per_batch=1)
        jobs.run(spark, lambda: jobs.start_topic(messages, "order-events", folder, availableNow=True))

    go()
    _write(source, "2.json", _message("b", 1), _message("c", 1), _message("d", 2), _message("x", 2, topic="review-events"))
    go()
    bronze = spark.read.parquet(f"{folder}/bronze/order-events")
    assert sorted(r["event_id"] for r in bronze.collect()) == ["a", "b", "c", "d"]
    metrics = jobs.read_metrics(spark, f"{folder}/metrics/order-events")
    assert sorted(r["event_count"] for r in metrics.collect()) == [1, 3]
    assert jobs.totals(metrics).first()["total_count"] == 4
    assert jobs.latest_window(metrics).first()["event_count"] == 1


def test_late_events(spark, folder, tmp_path):
    for i, m in enumerate((_message("a", 30), _message("b", 40), _message("late", 1), _message("e", 41))):
        _write(tmp_path / "in", f"{i}.json", m)
    for watermark, expected in (("2 minutes", {"a", "b", "e"}), (None, {"a", "b", "late", "e"})):
        root = f"{folder}/{watermark is None}"
        messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE, files_per_batch=1, latestFirst="false")
        jobs.run(spark, lambda m=messages, r=root, w=watermark: jobs.start_topic(m, "order-events", r, w, availableNow=True))
        assert {r["event_id"] for r in spark.read.parquet(f"{root}/bronze/order-events").collect()} == expected


def test_window_emitted_twice_counts_once(spark, folder):
    rows = lambda n: spark.sql(f"select timestamp'2018-01-01' window_start, timestamp'2018-01-01 00:01:00' window_end, 'X' event_type, {n}L event_count")
    for batch, n in enumerate((6, 9)):
        rows(n).write.mode("overwrite").parquet(f"{folder}/m/batch_id={batch}")
    assert jobs.totals(jobs.read_metrics(spark, f"{folder}/m")).first()["total_count"] == 9


def test_retention(spark):
    rows = spark.range(50).select((F.lit("2018-01-01").cast("timestamp") + F.make_dt_interval(hours="id")).alias("window_start"))
    assert jobs.retained_series(rows).count() == 25


def test_topics_to_json(spark, folder, tmp_path):
    _write(tmp_path / "in", "1.json", _message("a", 1), _message("b", 1, topic="review-events"))
    jobs.run(spark, lambda: [jobs.route_topics_json(jobs.file_source(spark, f"{folder}/in", ENVELOPE), f"{folder}/out", f"{folder}/cp", availableNow=True)])
    assert sorted(p.name for p in (tmp_path / "out").glob("topic=*")) == ["topic=order-events", "topic=review-events"]


def test_folded_metrics(spark, folder, tmp_path):
    for i in range(9):
        _write(tmp_path / "in", f"{i}.json", _message(f"a{i}", i % 3), _message(f"b{i}", 5))
    messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE, files_per_batch=1)
    counts = jobs.minute_counts(jobs.topic_events(messages, "order-events"))
    jobs.run(spark, lambda: [jobs.write_metrics(counts, f"{folder}/m", f"{folder}/cp", fold_every=2, availableNow=True)])
    got = {r["window_start"].minute: r["event_count"] for r in jobs.read_metrics(spark, f"{folder}/m").collect()}
    assert got == {0: 3, 1: 3, 2: 3, 5: 9}
    assert len(list((tmp_path / "m").glob("batch_id=*"))) <= 4 and len(list((tmp_path / "m_folded").glob("upto=*"))) <= 2
    jobs.fold_metrics(spark, f"{folder}/m", 7)  # a batch that runs again folds again
    assert jobs.totals(jobs.read_metrics(spark, f"{folder}/m")).first()["total_count"] == 18
    keys = {r["key"]: r["event_count"] for r in jobs.metric_keys(jobs.read_metrics(spark, f"{folder}/m"), "orders").collect()}
    assert keys["orders:latest:ORDER_CREATED"] == 9 and keys["orders:total:ORDER_CREATED"] == 18 and keys["orders:timeseries:ORDER_CREATED:2018-01-01 00:01:00"] == 3


def test_three_topics_and_six_queries(spark, folder, tmp_path):
    kinds = {"order-events": "ORDER_CREATED", "delivery-events": "DELIVERY_STARTED", "review-events": "REVIEW_CREATED"}
    _write(tmp_path / "in", "1.json", *[_message(f"{t}{i}", i, k, t) for t, k in kinds.items() for i in range(3)])

    def start():
        messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE)
        made = [q for t in kinds for q in jobs.start_topic(messages, t, folder, availableNow=True)]
        assert len(made) == 6
        return made

    jobs.run(spark, start)
    for topic, kind in kinds.items():
        assert {r["event_type"] for r in spark.read.parquet(f"{folder}/bronze/{topic}").collect()} == {kind}
        assert jobs.totals(jobs.read_metrics(spark, f"{folder}/metrics/{topic}")).first()["total_count"] == 3


def test_wait_for_any(spark, folder, tmp_path):
    _write(tmp_path / "in", "1.json", _message("a", 1))
    started = []

    def start():
        messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE)
        started.append(jobs.write_bronze(messages, f"{folder}/once", f"{folder}/cp1", availableNow=True))
        started.append(jobs.write_bronze(messages, f"{folder}/always", f"{folder}/cp2", processingTime="1 second"))
        return started

    spark.streams.resetTerminated()
    jobs.run(spark, start, wait_any=True)
    assert not started[0].isActive and started[1].isActive
    started[1].stop()
    spark.streams.resetTerminated()


def test_kafka_options(spark):
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, k, v):
            self.seen[k] = v
            return self

        def options(self, **more):
            self.seen |= more
            return self

        def load(self):
            return self.seen

    class Session:
        readStream = Reader()

    got = jobs.kafka_source(Session(), "a:9092,b:9092", ["order-events", "review-events"], maxOffsetsPerTrigger="10")
    assert got == {"format": "kafka", "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "order-events,review-events", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10"}
    # the connector's columns: keys and values are bytes
    envelope = spark.createDataFrame([(b"k", b'{"event_id":"e","event_type":"X","event_time":"2018-01-01 00:00:00"}', "order-events", 0, 5)], "key binary, value binary, topic string, partition int, offset long")
    assert jobs.topic_events(envelope, "order-events").first()["event_id"] == "e"


def _topic_rows(spark, root, name="events"):
    return sorted(r["event_id"] for r in topics.read_events(spark, root, "order-events", name).collect())


def test_one_query_for_all_sinks(spark, folder, tmp_path):
    """Events once, late ones aside, counts and totals; a batch that runs again changes nothing."""
    root = f"{folder}/topic"
    for i, lines in enumerate(([_message("a", 30), _message("a", 30), _message("b", 31)], [_message("a", 30), _message("c", 40)], [_message("late", 1), _message("c", 40), _message("d", 41)], [_message("b", 39), _message("e", 41)])):
        _write(tmp_path / "in", f"{i}.json", *lines)
    messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE, files_per_batch=1)
    jobs.run(spark, lambda: [topics.start(messages, "order-events", root, "2 minutes", availableNow=True)])
    expected = lambda: (_topic_rows(spark, root), _topic_rows(spark, root, "late"), sorted((r["window_start"].minute, r["event_count"]) for r in topics.read_counts(spark, root).collect()), topics.read_totals(spark, root).first()["total_count"])
    got = expected()
    assert got[0] == ["a", "b", "c", "d", "e"] and got[1] == ["late"] and got[3] == 5 and sum(n for _, n in got[2]) == 5
    batch = jobs.topic_events(spark.read.schema(ENVELOPE).json(f"{folder}/in/3.json"), "order-events")
    for _ in range(2):
        topics.write_batch(batch, 3, root, "2 minutes", schema=topics.schema_of("order-events"))
        assert expected() == got


def test_no_delay_deduplicates_for_ever(spark, folder, tmp_path):
    root = f"{folder}/topic"
    for i in range(7):
        _write(tmp_path / "in", f"{i}.json", _message("x", 1), _message(f"n{i}", 50 - i))
    messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE, files_per_batch=1)
    jobs.run(spark, lambda: [topics.start(messages, "order-events", root, None, fold_every=2, availableNow=True)])
    assert _topic_rows(spark, root) == sorted(["x", *[f"n{i}" for i in range(7)]]) and _topic_rows(spark, root, "late") == []


def test_compaction_over_a_restart(spark, folder, tmp_path):
    """Folds between stops lose no row and double none; a fold that stopped midway is as if it had not begun."""
    root, schema = f"{folder}/topic", topics.schema_of("order-events")
    for i in range(10):
        _write(tmp_path / "in", f"{i}.json", _message(f"a{i}", i), _message(f"b{i}", i))
        if i in (2, 5, 9):
            messages = jobs.file_source(spark, f"{folder}/in", ENVELOPE, files_per_batch=1)
            jobs.run(spark, lambda: [topics.start(messages, "order-events", root, "2 minutes", fold_every=2, availableNow=True)])
            held = topics.read_events(spark, root, "order-events")
            assert held.count() == 2 * (i + 1)
            assert topics.read_totals(spark, root).first()["total_count"] == 2 * (i + 1)
    assert len(list((tmp_path / "topic/events").glob("batch_id=*"))) <= 4
    # events get a segment for each fold, so none is written again; what is bounded is folded into one
    sizes = {f: spark.read.parquet(f"{root}/events/_folded/upto={f}").count() for f in (1, 3, 5, 7, 9)}
    assert sizes == dict.fromkeys((1, 3, 5, 7, 9), 4) and batches.folds(spark, f"{root}/events") == {1: -1, 3: 1, 5: 3, 7: 5, 9: 7}
    assert sorted(p.name for p in (tmp_path / "topic/counts/_folded").glob("upto=*")) == ["upto=7", "upto=9"]
    (tmp_path / "topic/events/_folded/upto=99").mkdir(parents=True)
    (tmp_path / "topic/events/_folded/upto=99/part-0.parquet").write_text("half a file")
    assert len(_topic_rows(spark, root)) == 20
    topics.fold_topic(spark, root, 9, "2 minutes", jobs.RETENTION, schema)
    assert len(_topic_rows(spark, root)) == 20 and topics.read_totals(spark, root).first()["total_count"] == 20
    seen = batches.read(spark, f"{root}/seen", topics.SEEN)
    assert seen.count() < 12  # ids that can no longer repeat in time are forgotten


def test_retention_keeps_totals(spark, folder):
    """Three days of windows, a batch for every hour: the folded table holds a day, totals hold all."""
    root = f"{folder}/topic"
    for hour in range(72):
        rows = spark.sql(f"select 'e{hour}' event_id, 'X' event_type, timestamp'2018-01-01' + make_dt_interval(0, {hour}) event_time")
        topics.batches.write(jobs.minute_counts(rows), f"{root}/counts", hour)
        if hour % 24 == 23:
            batches.fold(spark, f"{root}/counts", topics.COUNTS, hour, lambda r: topics.carried(r, jobs.RETENTION))
    assert topics.read_counts(spark, root).count() == 25 and topics.read_totals(spark, root).first()["total_count"] == 72
    folded = spark.read.parquet(f"{root}/counts/_folded/upto=71")
    assert folded.count() == 26 and folded.where("window_start is null").first()["event_count"] == 47


def test_a_batch_of_days_is_written_by_several_tasks(spark, folder, tmp_path, monkeypatch):
    """The files of a batch are as many as its tasks, and still one batch each."""
    monkeypatch.setattr(queries, "scratch", lambda s, name: f"{folder}/{name}")
    queries._topic(spark, SMALL, None)
    assert all(len(list((tmp_path / f"topic/in/batch={i}").glob("part-*"))) > 1 for i in range(4))
    assert len(list((tmp_path / "topic/topic/checkpoint/commits").glob("[0-9]*"))) == 5


def test_topics_are_made_by_one_write(spark, folder, tmp_path, monkeypatch):
    """No topic waits for another, and events are made by compiled code; unknown states and times make no event."""
    monkeypatch.setattr(queries, "scratch", lambda s, name: f"{folder}/{name}")
    routed = queries.routed_topics(spark, SMALL)
    assert list((tmp_path / "routed/in").glob("part-*")) and len(list((tmp_path / "routed/checkpoint/commits").glob("[0-9]*"))) == 1
    assert {r["topic"] for r in routed.select("topic").distinct().collect()} == {"order-events", "delivery-events", "review-events"}
    plan = queries.order_events(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert any(line.lstrip(" +-:").startswith("*(") for line in plan.splitlines() if "Generate explode" in line)
    rows = spark.sql("select * from values ('a', 'x', null, timestamp_ntz'2018-01-01 00:00:00', null), ('b', 'x', 'canceled', null, timestamp_ntz'2018-01-02 00:00:00'), ('c', null, 'canceled', null, null) as t(order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at)")
    assert sorted(r["event_id"] for r in events.order_events(rows).collect()) == ["ORDER_APPROVED_b", "ORDER_CREATED_a"]
