"""Marts from stored states against full rebuilds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import incremental, marts, states

DDL = "order_event_date date, order_id string, customer_id string, product_id string, item_total_amount double, item_price double, item_freight_value double"


def test_states_over_loads(spark, folder):
    """Orders and customers that come again in a later load count once; null ones not at all; a load that runs again changes nothing."""
    day = lambda d: dt.date(2018, 1, d)
    loads = [
        [(day(1), "o1", "c1", "p1", 5.0, 4.0, 1.0), (day(1), "o2", "c1", "p2", 50.0, 40.0, 10.0), (day(2), "o3", None, "p1", None, None, None)],
        [(day(1), "o1", "c1", "p2", 1.25, 1.0, 0.25), (day(1), None, "c2", "p1", 2.0, 2.0, 0.0), (day(3), "o4", "c1", "p1", 7.0, 7.0, 0.0), (None, "o5", "c3", "p1", 1.0, 1.0, 0.0)],
        [(day(1), f"x{i}", f"y{i % 7}", "p1", 1.0, 1.0, 0.0) for i in range(70_000)],
    ]
    path = f"{folder}/states"
    for load in (0, 1, 1, 2):
        rows = spark.createDataFrame(loads[load], DDL)
        ids = {c: states.dense_ids(rows.select(c), f"{folder}/ids-{c}") for c in states.COUNTED.values()}
        states.add_states(rows, ["order_event_date"], path, load, ids)
    whole = spark.createDataFrame([r for rows in loads for r in rows], DDL)
    got = marts.daily_columns(marts.from_states(states.merged(spark, path, ["order_event_date"])))
    expected = marts.daily_sales(whole)
    assert sorted(map(tuple, got.select(*expected.columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    ids = spark.read.parquet(f"{folder}/ids-order_id").collect()
    assert sorted(r["id"] for r in ids) == list(range(1, len(ids) + 1)) and len({r["key"] for r in ids}) == len(ids)


def test_dictionary_is_not_shuffled(spark, folder):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"))
        path = f"{folder}/ids"
        states.dense_ids(keys(0, 100), path, 8)
        ids = states.dense_ids(keys(50, 160), path, 8)
        assert sorted(r["id"] for r in ids.collect()) == list(range(1, 161)) and ids.select("key").distinct().count() == 160
        member = keys(0, 20).withColumnRenamed("k", "key").join(ids, "key")
        plan = member._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        # a load that stopped between dictionary and index
        incremental.KeyIndex(spark, path, T.StructType([T.StructField("key", T.StringType())]), 8).begin()
        spark.createDataFrame([("x", 161)], "key string, id long").write.mode("append").parquet(path)
        again = states.dense_ids(keys(0, 5).union(spark.createDataFrame([("x",), ("y",)], "k string")), path, 8)
        assert {r["key"]: r["id"] for r in again.where("key in ('x', 'y')").collect()} == {"x": 161, "y": 162}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_dense_ids_of_nothing(spark, folder):
    none = spark.createDataFrame([(None,)], "k string")
    assert states.dense_ids(none, f"{folder}/ids").count() == 0
    assert [tuple(r) for r in states.dense_ids(none.fillna("a"), f"{folder}/ids").collect()] == [("a", 1)]
