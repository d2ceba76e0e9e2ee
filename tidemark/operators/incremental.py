"""Incremental loads: append what the target does not hold yet. One writer at a time for each target.

Beside a fact lies an index of its keys: Parquet, in buckets by the hash of the whole key, appended with the fact. A load joins
new rows with it by its buckets, so only the new rows are shuffled, whatever has been loaded before, and only the key columns
of the history are read. A mark is set before a load writes and taken off when fact and index both hold it: a load that
finds one, or a fact without an index, makes the index anew from the fact.

Rows that lie by one column of their key (``within``, say the order) need not be dealt by the whole key: index and join then go by that
column alone, and the others are compared within its value. Such a value should have few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import sinks
from tidemark.sources.readers import read_or_empty
from tidemark.sources.sinks import append, current

#: Buckets of a key index, at least. There should be as many as shuffle partitions, or Spark deals the index anew.
BUCKETS = 64
#: Appends after which an index is written anew, so that a bucket has few files.
MERGE_EVERY = 64


class KeyIndex(NamedTuple):
    """The keys of the fact at ``path``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    buckets: int
    #: Columns of the fact that the index has besides the keys.
    extra: T.StructType = T.StructType([])
    #: The key column that buckets go by; None: all.
    within: str | None = None

    @property
    def by(self) -> list[str]:
        return [self.within] if self.within else self.keys

    @property
    def keys(self) -> list[str]:
        return self.schema.names

    def _at(self, name: str = "") -> str:
        return f"{self.path}_keys/{name}"

    def _exists(self, name: str) -> bool:
        fs, at = sinks._file_system(self.spark, self._at(name))
        return fs.exists(at)

    def _files(self) -> str:
        return self._at(self._name())

    def _name(self) -> str:
        return f"buckets-{self.buckets}" + (f"-by-{self.within}" if self.within else "")

    def table(self) -> DataFrame:
        """The keys, bucketed; an external table of this session over the files."""
        name = f"keys_{hashlib.md5(self._files().encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*self.schema, *self.extra))
        by = ", ".join(f"`{k}`" for k in self.by)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self._files()}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _write(self, rows: DataFrame, mode: str) -> None:
        name = f"keys_{hashlib.md5(self._files().encode()).hexdigest()}"
        self.table()
        dealt = rows.select(*self.keys, *self.extra.names).repartition(self.buckets, *self.by)  # a file for each bucket
        if mode == "overwrite":
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            sinks.remove(self.spark, self._files())
            self.table()
        dealt.write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def ready(self, fact: DataFrame) -> None:
        """Make the index anew if it may lack keys of the fact."""
        if self._exists("_loading") or not self._exists(self._name()):
            self._write(fact, "overwrite")
            self.done()

    def begin(self) -> None:
        fs, at = sinks._file_system(self.spark, self._at("_loading"))
        fs.create(at, True).close()

    def add(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def done(self) -> None:
        sinks.remove(self.spark, self._at("_loading"))

    def merge_if_many(self, fact: Callable[[], DataFrame]) -> None:
        """Write the index anew after many appends."""
        if self.appends() > MERGE_EVERY:
            self.begin()
            self.ready(fact())

    def appends(self) -> int:
        """How many files the fullest bucket has, as far as their count tells."""
        fs, at = sinks._file_system(self.spark, self._files())
        return -(-sum(1 for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")) // self.buckets)


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """Rows whose key the existing table lacks. Rows with a null in the key are rejected: they would load again each time.

    With ``within`` the join goes by that column of the key, so tables that lie by it are not dealt again.
    """
    known = existing.select(*keys)
    if within is None:
        return rows.dropna(subset=keys).join(known, keys, "left_anti")
    same = F.col(f"r.{within}") == F.col(f"e.{within}")
    for k in keys:
        if k != within:
            same &= F.col(f"r.{k}").between(F.col(f"e.{k}"), F.col(f"e.{k}"))  # an equality would be a key to deal by
    return rows.dropna(subset=keys).alias("r").join(known.alias("e"), same, "left_anti")


def buckets_of(spark: SparkSession, least: int = BUCKETS) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _files(spark: SparkSession, path: str) -> set[str]:
    """The data files of a table."""
    fs, at = sinks._file_system(spark, current(spark, path) or path)
    if not fs.exists(at):
        return set()
    found, names = fs.listFiles(at, True), set()
    while found.hasNext():
        file = found.next().getPath()
        if not file.getName().startswith(("_", ".")):
            names.add(file.toString())
    return names


def load_fact(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], month: str, time: str = "event_time", buckets: int | None = None, within: str | None = None) -> int:
    """Append the new rows to the fact at ``path``, by month; returns how many. A second run with the same rows adds none.

    Rows are computed once, as they are appended; their keys are read back from the files of the append. A first load has no history to join with.
    """
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
    index = KeyIndex(spark, path, schema, buckets or buckets_of(spark, 1 if within else BUCKETS), within=within)
    index.ready(read_or_empty(spark, path, rows.schema))
    timed, known = rows.where(F.col(time).isNotNull()), index.table()
    fresh = timed.dropna(subset=keys) if known.isEmpty() else new_rows(timed, known, keys, within)
    before = _files(spark, path)
    index.begin()
    append(fresh.select(*rows.columns), path, month)
    files = sorted(_files(spark, path) - before)
    added = spark.read.schema(rows.schema).option("basePath", current(spark, path) or path).parquet(*files).select(*keys) if files else spark.createDataFrame([], schema)
    n = added.count()
    if n:
        index.add(added)
    index.done()
    if n:
        index.merge_if_many(lambda: read_or_empty(spark, path, rows.schema))
    return n
