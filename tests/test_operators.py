"""Hand-written rows for the semantics that the driver's tables do not show."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_group
from tidemark.operators import dims, events, facts, incremental, indexing, marts, quality, sampling
from tidemark.plans import lake, queries
from tidemark.sources import bindings, readers, sinks

T = lambda s: dt.datetime.fromisoformat(s)


def test_bad_messages(spark):
    texts = [
        "garbage", '{"event_id":"b","event_time":"2018-01-01 00:00:00"}', '{"event_id":"c","event_type":"X","event_time":"not a ts"}',
        '{"event_id":"d","event_type":"X","event_time":"2018-01-01 00:00:00","extra":1,"review_score":5,"customer_id":NaN}',
    ]
    rows = spark.createDataFrame([("review-events", t) for t in texts], "topic string, value string")
    got = events.require_fields(events.parse_envelope(events.demux(rows, "review-events"), events.REVIEW_SCHEMA)).collect()
    assert [(r["event_id"], r["review_score"], r["customer_id"]) for r in got] == [("d", "5", None)]


def test_first_event_of_a_key(spark):
    rows = spark.createDataFrame([("o1", "C", "10:00", "a"), ("o1", "C", "09:00", "b"), ("o2", "C", "11:00", "c")], "order_id string, event_type string, event_time string, event_id string")
    got = events.first_per_key(rows, ["order_id", "event_type"], "event_time", "event_id")
    assert sorted(r["event_id"] for r in got.collect()) == ["b", "c"]


def test_item_fact_without_payment_or_items(spark):
    log = spark.createDataFrame([("e1", "ORDER_CREATED", T("2018-01-01 10:00:00"), "o1", "c1", "created"), ("e2", "ORDER_CREATED", T("2018-01-01 10:00:00"), "o2", "c1", "created")], "event_id string, event_type string, event_time timestamp_ntz, order_id string, customer_id string, order_status string")
    items = spark.createDataFrame([("o1", 1, "p", "s", T("2018-01-02 00:00:00"), 1.5, None)], "order_id string, order_item_id long, product_id string, seller_id string, shipping_limit_date timestamp_ntz, price double, freight_value double")
    paid = spark.createDataFrame([], "order_id string, payment_value double")
    got = facts.fact_order_item(log, items, paid).collect()
    assert [(r["order_id"], r["payment_total_value"], r["item_total_amount"], r["order_month"]) for r in got] == [("o1", None, None, "2018-01")]


def test_delivery_edges(spark):
    cols = "order_id string, order_purchase_timestamp timestamp_ntz, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
    day = lambda d: T(f"2018-01-{d:02d} 12:00:00")
    orders = spark.createDataFrame([("open", day(1), day(2), None, day(9)), ("on_time", day(1), day(2), day(9), day(9)), ("late", day(1), day(2), day(10), day(9)), ("late", day(3), None, None, None)], cols)
    log = spark.createDataFrame([(o, "DELIVERY_STARTED", day(2), o, "c") for o in ("open", "on_time", "late", "unknown")], "event_id string, event_type string, event_time timestamp_ntz, order_id string, customer_id string")
    got = {r["order_id"]: r for r in facts.fact_delivery(log, orders).collect()}
    assert len(got) == 4
    assert [(got[o]["is_delivered"], got[o]["is_delayed"], got[o]["delivery_days"]) for o in ("open", "on_time", "late", "unknown")] == [(False, False, None), (True, False, 8), (True, True, 9), (False, False, None)]
    assert got["late"]["delivery_status"] == "started"


def test_unknown_status_is_delivered(spark):
    orders = spark.createDataFrame([("a", "c", None, T("2018-01-01 00:00:00"), None, None), ("b", "c", "canceled", T("2018-01-01 00:00:00"), None, None)], "order_id string, customer_id string, order_status string, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    assert [r["order_id"] for r in events.delivery_events(orders).collect()] == ["a"]


def test_bad_score_and_repeated_reviews(spark):
    log = spark.createDataFrame([("e", "REVIEW_CREATED", T("2018-01-01 00:00:00"), "r", "o", "c", "x")], "event_id string, event_type string, event_time timestamp_ntz, review_id string, order_id string, customer_id string, review_score string")
    reviews = spark.createDataFrame([("r", "2018-01-01 00:00:00", "2018-01-04 00:00:00"), ("r", "2018-01-02 00:00:00", None)], "review_id string, review_creation_date string, review_answer_timestamp string")
    got = facts.fact_review(log, reviews).collect()
    assert [(r["review_score"], r["review_answer_days"]) for r in got] == [(None, 3)]


def test_segment_without_customers(spark):
    fact = spark.createDataFrame([(None, "o", "p", 1.0, 1.0, 0.0)], "customer_id string, order_id string, product_id string, item_total_amount double, item_price double, item_freight_value double")
    dim = spark.createDataFrame([], "customer_id string, age_group string, sex string, occupation string")
    row = marts.customer_segment_sales(fact, dim).first()
    assert (row["customer_count"], row["avg_customer_amount"], row["total_sales_amount"]) == (0, None, 1.0)
    products = spark.createDataFrame([("q", "unknown")], "product_id string, product_category_name_english string")
    assert marts.category_sales(fact, products).first()["product_category_name_english"] is None


def test_ages(spark):
    rows = spark.createDataFrame([(a,) for a in (29, 30, 69, 70, None)], "age int")
    assert [r[0] for r in rows.select(age_group("age")).collect()] == ["20s", "30s", "60s", "70+", None]


def test_quotas():
    assert list(sampling.quotas(103).values()) == [5, 9, 11, 14, 15, 49]


def test_quota_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(50)], "k long, g string")
    got = sampling.quota_sample(rows, "g", "k", {"a": 7, "b": 10}).collect()
    uses = sorted(sum(r["k"] == k for r in got) for k in range(3))
    assert uses == [2, 2, 3]
    assert sorted(r["slot"] for r in got if r["g"] == "b") == list(range(10))
    assert len({r["k"] for r in got if r["g"] == "b"}) == 10
    with pytest.raises(ValueError, match="none"):
        sampling.quota_sample(rows, "g", "k", {"none": 1})


def test_persona_columns(spark):
    rows = spark.createDataFrame([("F", "41", " Ada  writes"), ("M", "x", "")], "gender string, age string, text string")
    got = sampling.normalize_persona(rows, "text").orderBy("sex").collect()
    assert [(r["sex"], r["age_group"], r["customer_name"]) for r in got] == [("F", "40s", "Ada"), ("M", None, None)]
    with pytest.raises(ValueError, match="persona"):
        sampling.normalize_persona(rows.drop("text"))


def test_helper_columns_take_free_names(spark):
    """Columns of a caller that are named like helpers stay as they are."""
    rows = spark.range(6).selectExpr("id k", "id * 2 _range", "id * 3 _nth", "id * 5 _before", "id * 7 _event", "id % 2 g")
    got = sorted(map(tuple, indexing.with_row_index(rows, "k", name="_nth_").collect()))
    assert got == [(i, 2 * i, 3 * i, 5 * i, 7 * i, i % 2, i + 1) for i in range(6)]
    assert sorted(map(tuple, events.first_per_key(rows, ["g"], "k").collect())) == [(i, 2 * i, 3 * i, 5 * i, 7 * i, i) for i in range(2)]


def test_row_index_is_a_permutation(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = indexing.with_row_index(rows, "k").collect()
    assert all(r["row_idx"] == r["k"] + 1 for r in got) and len(got) == 5000
    assert indexing.with_row_index(rows.limit(0), "k").count() == 0


def test_customer_zip_drops_the_longer_side(spark):
    people = spark.createDataFrame([(str(i), f"u{i}", i) for i in range(3)], "customer_id string, customer_unique_id string, customer_order long")
    personas = bindings.personas(spark, "/root/testdata/sf0.001").limit(2)
    assert dims.dim_customer(people, personas).count() == 2


def test_incremental_load(spark, folder):
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(T("2018-01-01 00:00:00")).alias("event_time"), F.when(F.col("id") % 2 == 0, "2018-01").otherwise("2018-02").alias("month"))
    path = f"{folder}/fact"
    parts = [rows.where(F.col("k") % 3 == i) for i in range(3)]
    assert [incremental.load_fact(spark, p, path, ["k"], "month") for p in parts] == [34, 33, 33]
    assert incremental.load_fact(spark, rows.unionByName(rows.limit(1).withColumn("k", F.lit(None).cast("long"))), path, ["k"], "month") == 0
    stored = readers.read_table(spark, path)
    assert stored.count() == 100 and dict(stored.dtypes)["month"] == "string"
    assert "PartitionFilters: [isnotnull(month" in lake.months(stored, "month", "2018-02")._jdf.queryExecution().toString()


def test_read_or_empty(spark, folder, tmp_path):
    assert readers.read_or_empty(spark, f"{folder}/none", "a int").count() == 0
    (tmp_path / "empty").mkdir()
    assert readers.read_or_empty(spark, f"{folder}/empty", "a int").columns == ["a"]


def test_csv_with_quotes(spark, folder, tmp_path):
    (tmp_path / "x.csv").write_text('id,text,n\n1,"a\nb ""c""",3\n')
    row = readers.read_csv(spark, f"{folder}/x.csv").first()
    assert (row["text"], row["n"]) == ('a\nb "c"', 3)
    rows = spark.createDataFrame([("2018-01-01 10:00:00",), ("never",)], "t string")
    assert [r[0] for r in readers.coerce_timestamps(rows, "t").collect()] == [T("2018-01-01 10:00:00"), None]


def test_event_jsonl(spark, folder, tmp_path):
    rows = spark.createDataFrame([("b", "2018-01-02 00:00:00"), ("é", "2018-01-01 00:00:00"), ("c", None)], "event_id string, event_time string")
    sinks.write_jsonl(rows, f"{folder}/out", "event_time", "event_id")
    got = readers.read_event_jsonl(spark, f"{folder}/out", "event_id string, event_time string")
    assert sorted(r["event_id"] for r in got.collect()) == ["b", "é"]


def test_jdbc(spark):
    url = "jdbc:derby:memory:marts;create=true"
    rows = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    for _ in range(2):
        sinks.jdbc_overwrite(rows, url, "mart")
    assert spark.read.jdbc(url, "mart").count() == 2
    sinks.jdbc_overwrite(rows, url, "few", limit=1)
    assert spark.read.jdbc(url, "few").count() == 1


def test_profile_and_check(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    row = quality.profile("t", rows, ["k"]).first()
    assert tuple(row) == ("t", 4, 2, 1)
    with pytest.raises(ValueError, match="t: 4 rows"):
        quality.check(quality.profile("t", rows, ["k"]))
    assert tuple(quality.profile("e", rows.limit(0), ["k"]).first()) == ("e", 0, 0, 0)


def test_lake_run(spark, folder):
    d = "/root/testdata/sf0.001"
    tables = {
        "orders": bindings.orders(spark, d), "order_items": bindings.order_items(spark, d), "payments": bindings.payments(spark, d), "reviews": bindings.reviews(spark, d),
        "customers": bindings.customers(spark, d), "products": bindings.products(spark, d), "category_translation": bindings.category_translation(spark),
        "sellers": bindings.sellers(spark, d), "personas": bindings.personas(spark, d),
    }
    timed = lambda df: df.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    tables["order-events"] = timed(events.order_events(tables["orders"], ordered=True))
    tables["delivery-events"] = timed(events.delivery_events(tables["orders"], ordered=True))
    tables["review-events"] = timed(events.review_events(tables["reviews"], tables["orders"], ordered=True))
    for name, df in tables.items():
        sinks.overwrite(df, f"{folder}/bronze/{name}")
    written = []
    first = lake.run(spark, folder, lambda df, name: written.append((name, df.count())))
    assert min(first.values()) > 0 and len(written) == 5
    assert set(lake.run(spark, folder).values()) == {0}
    lake.ingest_raw(spark, {"again": lake.SourceSpec(f"{folder}/bronze/sellers", "parquet")}, folder)
    assert readers.read_table(spark, f"{folder}/bronze/again").count() == tables["sellers"].count()


def test_items_are_dealt_by_order_once(spark):
    """One exchange of items and of events, by order; the joins and the sums by order need no other."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = "/root/testdata/sf0.001"
        log = events.order_events(bindings.orders(spark, d)).withColumn("event_time", F.col("event_time").try_cast("timestamp_ntz"))
        fact = facts.fact_order_item(log, bindings.order_items(spark, d), bindings.payments(spark, d))
        plan = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        by = lambda line: [c.split("#")[0] for c in line.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1]]
        assert [by(x) for x in plan(fact)] == [["order_id"]] * 3
        once = fact.groupBy("order_event_date", "order_id", "customer_id").count()
        assert [by(x) for x in plan(once)] == [["order_id"]] * 2  # payments are not asked for
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_ordered_marts_and_events(spark):
    day = lambda d: dt.date(2018, 1, d)
    rows = [(day(3), "o1", "c1", "p1", 5.0, 4.0, 1.0), (day(1), "o2", "c1", "p2", 50.0, 40.0, 10.0), (day(2), "o3", None, "p1", None, None, None), (day(1), "o2", "c1", "p2", 1.0, 1.0, 0.0)]
    fact = spark.createDataFrame(rows, "order_event_date date, order_id string, customer_id string, product_id string, item_total_amount double, item_price double, item_freight_value double")
    daily = marts.daily_sales(fact, ordered=True).collect()
    assert [(r["order_event_date"], r["order_count"], r["item_count"], r["customer_count"], r["total_sales_amount"], r["avg_order_amount"]) for r in daily] == [
        (day(1), 1, 2, 1, 51.0, 51.0), (day(2), 1, 1, 0, None, None), (day(3), 1, 1, 1, 5.0, 5.0)
    ]
    products = spark.createDataFrame([("p1", "a"), ("p2", "b")], "product_id string, product_category_name_english string")
    assert [(r[0], r["avg_item_price"]) for r in marts.category_sales(fact, products, ordered=True).collect()] == [("b", 20.5), ("a", 4.0)]
    people = spark.createDataFrame([("c1", "20s", "F", "x")], "customer_id string, age_group string, sex string, occupation string")
    assert [r["total_sales_amount"] for r in marts.customer_segment_sales(fact, people, ordered=True).collect()] == [56.0, None]
    got = [(r["event_time"], r["event_id"]) for r in events.order_events(bindings.orders(spark, "/root/testdata/sf0.001"), ordered=True).collect()]
    assert [t for t, _ in got] == sorted(t for t, _ in got) and len(got) > 1000


def test_marts_join_items_added_up_by_order(spark):
    """What is dealt by product or customer is a row for each order, and each order is counted once wherever its rows lie."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        day = dt.date(2018, 1, 1)
        rows = [(day, o, c, p, 2.0, 1.5, 0.5) for o, c, p in (("o1", "c1", "p1"), ("o1", "c1", "p2"), ("o1", "c2", "p1"), ("o2", None, "p3"), (None, "c1", "p1"), ("o3", "c3", None))] * 3
        fact = spark.createDataFrame(rows, "order_event_date date, order_id string, customer_id string, product_id string, item_total_amount double, item_price double, item_freight_value double").repartition("order_id")
        products = spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "b")], "product_id string, product_category_name_english string")
        people = spark.createDataFrame([("c1", "20s", "F", "x"), ("c2", "20s", "F", "x")], "customer_id string, age_group string, sex string, occupation string")
        category, segment = marts.category_sales(fact, products), marts.customer_segment_sales(fact, people)
        for mart, key in ((category, "product_id"), (segment, "customer_id")):
            plan = mart._jdf.queryExecution().executedPlan().toString().splitlines()
            dealt = next(i for i, line in enumerate(plan) if f"Exchange hashpartitioning({key}#" in line)
            assert "HashAggregate" in "".join(plan[dealt + 1 : dealt + 3])
        assert {r[0]: (r["order_count"], r["item_count"], r["total_sales_amount"], r["avg_item_price"]) for r in category.collect()} == {"a": (1, 12, 24.0, 1.5), "b": (1, 3, 6.0, 1.5), None: (1, 3, 6.0, 1.5)}
        assert {r[0]: (r["order_count"], r["customer_count"], r["item_count"], r["total_sales_amount"]) for r in segment.collect()} == {"20s": (1, 2, 12, 24.0), None: (2, 1, 6, 12.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_replaced_mart_computes_the_fact_once(spark, monkeypatch):
    """Both marts come from one pass, equal to each alone, with unknown types, states, orders and customers among the rows."""
    made, day = spark.sparkContext.accumulator(0), lambda n: dt.date(2018, n, 1)
    rows = [(day(1 + i % 2), o, c, e, st, 2.5, 2.0, 0.5) for i, (o, c, e, st) in enumerate((o, c, e, st) for o, c in (("o1", "c1"), ("o1", "c2"), ("o2", "c1"), ("o3", None), (None, "c3")) for e in ("ORDER_CREATED", "ORDER_APPROVED", None) for st in ("canceled", "shipped", None))]
    fact = spark.createDataFrame([*rows, (None, "o4", "c4", "ORDER_CREATED", None, 1.0, 1.0, None)], "order_event_date date, order_id string, customer_id string, event_type string, order_status string, item_total_amount double, item_price double, item_freight_value double").coalesce(2)
    both = marts.daily_sales_both(fact)
    for net, alone in ((False, fact), (True, marts.net_of_cancellations(fact))):
        assert sorted(both.where(F.col("net") == net).drop("net").collect(), key=str) == sorted(marts.daily_sales(alone).collect(), key=str)
    once = F.udf(lambda x: made.add(1) or x, "double").asNondeterministic()
    counted = fact.withColumn("item_price", once("item_price"))
    monkeypatch.setattr(queries, "fact_order_item", lambda s, d: counted)
    got = queries.replaced_daily_sales(spark, "").select(*marts.daily_sales(fact).columns).collect()
    assert made.value == fact.count() and sorted(got, key=str) == sorted(marts.daily_sales(fact).collect(), key=str)


def test_raw_csv_to_bronze(spark, folder, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/orders.csv").write_text('order_id,at,note\n1,2018-01-02 03:04:05,"two\nlines"\n2,never,"a ""quote"""\n')
    lake.ingest_raw(spark, {"orders": lake.SourceSpec(f"{folder}/raw/orders.csv", "csv", "order_id string, at string, note string", ("at",))}, f"{folder}/lake")
    got = readers.read_table(spark, f"{folder}/lake/bronze/orders").orderBy("order_id").collect()
    assert [tuple(r) for r in got] == [("1", T("2018-01-02 03:04:05"), "two\nlines"), ("2", None, 'a "quote"')]


def _files(path, month):
    return [p for p in (path / f"month={month}").glob("*.parquet")]


def test_a_large_month_is_written_by_several_tasks(spark, folder, tmp_path):
    keep = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 200_000, 1, 24).select(F.col("id"), F.xxhash64("id").alias("v"), F.when(F.col("id") % 100 < 95, "2018-01").when(F.col("id") % 100 < 98, "2018-02").otherwise("2018-03").alias("month"))
        sinks.append(rows, f"{folder}/appended", "month")
        sinks.overwrite(rows, f"{folder}/replaced", "month")
        version = next((tmp_path / "replaced").glob("version-*"))
        for root in (tmp_path / "appended", version):
            assert len(_files(root, "2018-01")) >= 8
            assert len(_files(root, "2018-03")) <= 4
        few = rows.where("month <> '2018-01'").limit(1000)
        sinks.append(few, f"{folder}/few", "month")
        assert [len(_files(tmp_path / "few", m)) for m in ("2018-02", "2018-03")] == [1, 1]
        assert readers.read_table(spark, f"{folder}/replaced").count() == 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", keep)


def test_a_failed_write_leaves_the_table(spark, folder, tmp_path):
    rows = lambda n: spark.range(n).withColumn("month", F.lit("2018-01"))
    path = f"{folder}/t"
    sinks.overwrite(rows(5), path, "month")
    bad = rows(9).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    for _ in range(2):
        with pytest.raises(Exception, match="stop"):
            sinks.overwrite(bad, path, "month")
        assert readers.read_table(spark, path).count() == 5
    held = readers.read_table(spark, path)  # a reader that began with the version before
    sinks.overwrite(rows(6), path, "month")
    assert held.count() == 5 and readers.read_table(spark, path).count() == 6
    sinks.overwrite(rows(7), path)
    assert readers.read_table(spark, path).count() == 7
    assert sorted(p.name for p in (tmp_path / "t").glob("version-*")) == ["version-00000002", "version-00000003"]
    assert readers.read_or_empty(spark, f"{folder}/none", "id long").count() == 0
    sinks.overwrite(rows(0), path)
    assert readers.read_table(spark, path).count() == 0


def test_history_is_not_shuffled(spark, folder):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["order_id", "event_type"]
        rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("order_id"), F.when(F.col("id") % 2 == 0, "X").otherwise("Y").alias("event_type"), F.lit(T("2018-01-01 00:00:00")).alias("event_time"), F.lit("2018-01").alias("month"))
        path = f"{folder}/fact"
        assert [incremental.load_fact(spark, rows(0, n), path, keys, "month", buckets=8) for n in (100, 150, 150)] == [100, 50, 0]
        index = incremental.KeyIndex(spark, path, rows(0, 1).select(*keys).schema, 8)
        plan = incremental.new_rows(rows(0, 200), index.table(), keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "Aggregate" not in plan
        assert "SelectedBucketsCount: 8 out of 8" in plan
        # a load that stopped between fact and index: the index is made anew
        sinks.append(rows(150, 160), path, "month")
        index.begin()
        assert incremental.load_fact(spark, rows(0, 165), path, keys, "month", buckets=8) == 5
        assert readers.read_table(spark, path).count() == 165 and index.table().count() == 165
        # another number of buckets makes another index
        assert incremental.load_fact(spark, rows(0, 170), path, keys, "month", buckets=16) == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_a_load_computes_its_rows_once(spark, folder):
    """Rows are not computed again for their count or for the index, nor after the index has changed."""
    made = spark.sparkContext.accumulator(0)

    once = F.udf(lambda x: made.add(1) or x, "long").asNondeterministic()
    rows = lambda n: spark.range(0, n, 1, 3).select(F.col("id").cast("string").alias("order_id"), F.lit("X").alias("event_type"), F.lit(T("2018-01-01 00:00:00")).alias("event_time"), F.when(F.col("id") % 2 == 0, "2018-01").alias("month"), once("id").alias("v"))
    for within in (None, "order_id"):
        path, before = f"{folder}/fact-{within}", made.value
        assert [incremental.load_fact(spark, rows(n), path, ["order_id", "event_type"], "month", within=within) for n in (100, 150, 150)] == [100, 50, 0]
        assert made.value - before == 400
        assert readers.read_table(spark, path).select("order_id").distinct().count() == readers.read_table(spark, path).count() == 150


def test_new_rows_within_an_order(spark):
    """Tables that lie by the order are joined as they lie, on the whole key; nulls in a key match nothing."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["order_id", "n", "kind"]
        table = lambda rows: spark.createDataFrame(rows, "v long, order_id string, n long, kind string").repartition("order_id")
        rows = table([(1, "a", 1, "X"), (2, "a", 2, "X"), (3, "a", 1, "Y"), (4, "b", 1, "X"), (5, "b", None, "X"), (6, None, 1, "X"), (7, "c", 1, None), (8, "d", 1, "X")])
        held = table([(0, "a", 1, "X"), (0, "a", 2, "Y"), (0, "b", 2, "X"), (0, "b", None, "X"), (0, "d", 1, "X"), (0, "d", 1, "X")])
        for known in (held, rows.where("v in (1, 8)")):  # another table, and part of the same
            new = incremental.new_rows(rows, known, keys, "order_id")
            assert new._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
            assert sorted(map(tuple, new.collect())) == [(2, "a", 2, "X"), (3, "a", 1, "Y"), (4, "b", 1, "X")]
            assert sorted(map(tuple, new.collect())) == sorted(map(tuple, incremental.new_rows(rows, known, keys).select(*rows.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_an_index_of_many_appends_is_merged(spark, folder, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_EVERY", 2)
    rows = lambda n: spark.range(n).select(F.col("id").alias("k"), F.lit(T("2018-01-01 00:00:00")).alias("event_time"), F.lit("2018-01").alias("month"))
    path = f"{folder}/fact"
    for i in range(1, 6):
        assert incremental.load_fact(spark, rows(i * 40), path, ["k"], "month", buckets=4) == 40
    index = incremental.KeyIndex(spark, path, rows(1).select("k").schema, 4)
    assert index.appends() <= 3 and index.table().count() == 200 and index.table().distinct().count() == 200


def test_quota_sample_ranks_only_what_it_draws(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sampling, "with_row_index", lambda df, *a, **k: seen.append(df.count()) or indexing.with_row_index(df, *a, **k))
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("g"), F.lit("x").alias("_shuffle"), F.lit("y").alias("_place"))
    got = sampling.quota_sample(rows, "g", "k", {"big": 100, "small": 50}).collect()
    assert len(got) == 150 and seen[0] < 400 and all(r["_shuffle"] == "x" and r["_place"] == "y" for r in got)
    ranked = sorted(((__import__("hashlib").md5(f"42:{i}".encode()).hexdigest(), i) for i in range(40_000) if i % 10))
    assert [r["k"] for r in sorted((r for r in got if r["g"] == "big"), key=lambda r: r["slot"])] == [i for _, i in ranked[:100]]


def test_csv_is_split_unless_quotes_run_over_lines(spark, folder, tmp_path):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        (tmp_path / "c").mkdir()
        (tmp_path / "c/a.csv").write_text("id,text\n" + "".join(f'{i},"a ""quoted"" word {i}"\n' for i in range(20_000)))
        assert readers.read_csv(spark, f"{folder}/c", "id long, text string").rdd.getNumPartitions() >= 8
        (tmp_path / "c/b.csv").write_text('id,text\n20000,"two\nlines"\n20001,plain\n')
        rows = readers.read_csv(spark, f"{folder}/c", "id long, text string")
        assert rows.count() == 20_002 and rows.where("id = 20000").first()["text"] == "two\nlines" and rows.where("id = 3").first()["text"] == 'a "quoted" word 3'
        assert dict(readers.read_csv(spark, f"{folder}/c").dtypes) == {"id": "int", "text": "string"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_a_failed_load_leaves_the_database_rows(spark):
    url = "jdbc:derby:memory:swap;create=true"
    rows = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    sinks.jdbc_overwrite(rows, url, "mart")
    bad = spark.range(50).select(F.when(F.col("id") == 40, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("id").cast("int")).alias("a"), F.lit(1.0).alias("b"))
    with pytest.raises(Exception, match="stop"):
        sinks.jdbc_overwrite(bad, url, "mart")
    assert sorted(r["a"] for r in spark.read.jdbc(url, "mart").collect()) == [1, 2]
    with pytest.raises(Exception):
        sinks.jdbc_overwrite(rows.withColumn("c", F.lit(1)), url, "mart")  # the table has no such column
    assert spark.read.jdbc(url, "mart").count() == 2
    sinks.jdbc_overwrite(rows.limit(1), url, "mart")
    assert spark.read.jdbc(url, "mart").count() == 1
