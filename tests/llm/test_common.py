"""Pinned tables and how they are let go of."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def there(df):
    return pathlib.Path(df.pinned_at.removeprefix("file://")).exists()


def test_temporary_tables(spark):
    with common.temporary(spark) as outer:
        a = common.pin(spark.range(3), "a")
        with common.temporary(spark) as inner:
            b, c = common.pin(spark.range(4), "b"), inner.keep(common.pin(spark.range(5), "c"))
        assert there(a) and not there(b) and there(c)
        e = outer.keep(common.pin(c.selectExpr("id * 2 as id"), "e"))
    assert not there(a) and not there(c) and there(e) and e.count() == 5
    common.unpin(e, spark.range(1))
    assert not there(e)
    with pytest.raises(ValueError), common.temporary(spark):
        kept = common.pin(spark.range(1), "after an error")
        raise ValueError
    assert there(kept)


def test_row_hash_of_any_columns(spark):
    df = spark.range(2).select(F.lit(1).alias("a"), F.create_map(F.lit("k"), "id").alias("m"), F.array(F.create_map(F.lit("k"), F.lit(1))).alias("n"))
    assert df.select(common.row_hash(df)).distinct().count() == 2
