"""Table writers.

A table that :func:`overwrite` makes is a folder of versions, of which a pointer names the current one: readers go by
:func:`tidemark.sources.readers.read_table`, and a write that fails midway leaves them the version before. The version before
the current one stays for readers that began with it and is removed by the next write, as are folders of failed writes.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
_VERSION = re.compile(r"version-(\d{8})")


def by_month(df: DataFrame, month: str) -> DataFrame:
    """Rows dealt by month, so that a small month is one file, and a large one as many as its size asks for: adaptive execution
    splits the partitions of a rebalance (never those of a repartition) and joins small ones."""
    return df.hint("rebalance", month)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version of a table; None where there is no pointer."""
    fs, at = _file_system(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{name.strip()}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Make ``name`` the current version: the pointer is written aside and renamed over the one before in a single step."""
    fs, aside = _file_system(spark, f"{path}/{POINTER}-new")
    stream = fs.create(aside, True)
    stream.write(bytearray(name, "utf-8"))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(aside.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    modes = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    modes[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(hadoop.Path(f"{path}/{POINTER}")), modes)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return []
    found = (_VERSION.fullmatch(s.getPath().getName()) for s in fs.listStatus(at))
    return sorted(int(m.group(1)) for m in found if m)


def overwrite(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the table at ``path`` in one step, when all of it is written. One writer at a time for each table."""
    spark = df.sparkSession
    was = current(spark, path)
    before = int(_VERSION.search(was).group(1)) if was else 0
    name = f"version-{before + 1:08d}"
    writer = (by_month(df, partition_by) if partition_by else df).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{name}")
    _point(spark, path, name)
    remove(spark, *[f"{path}/version-{v:08d}" for v in _versions(spark, path) if v not in (before, before + 1)])


def append(df: DataFrame, path: str, partition_by: str) -> None:
    by_month(df, partition_by).write.mode("append").partitionBy(partition_by).parquet(current(df.sparkSession, path) or path)


def jdbc_overwrite(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, truncate: bool = True, limit: int | None = None) -> None:
    """Replace the rows of a database table, which keeps its definition and indexes with ``truncate``.

    Rows are loaded into a table of its own first (``<table>_staging``), by all tasks, and then take the place of the old ones in a
    single transaction of the database: a load that fails leaves the old rows. Without ``truncate`` the table is dropped
    and made anew, for rows of another schema; that is not a single step.
    """
    rows, props, spark = df if limit is None else df.limit(limit), dict(properties or {}), df.sparkSession
    if not truncate:
        rows.write.jdbc(url, table, mode="overwrite", properties=props)
        return
    staging = f"{table}_staging"
    rows.write.jdbc(url, staging, mode="overwrite", properties=props)
    rows.limit(0).write.jdbc(url, table, mode="append", properties=props)  # makes the table where there is none
    settings = spark._jvm.java.util.Properties()
    for key, value in props.items():
        settings.setProperty(key, value)
    if "driver" in props:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(props["driver"])
    link = spark._jvm.java.sql.DriverManager.getConnection(url, settings)
    quote = link.getMetaData().getIdentifierQuoteString().strip()
    columns = ", ".join(f"{quote}{c}{quote}" for c in df.columns)
    try:
        link.setAutoCommit(False)
        statement = link.createStatement()
        statement.executeUpdate(f"DELETE FROM {table}")
        statement.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging}")
        link.commit()
        statement.executeUpdate(f"DROP TABLE {staging}")
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in the given order; nulls are left out, text is kept as it is."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders of any file system that the session can reach; missing ones are passed over."""
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
