"""Tables that a stream writes a batch at a time, each into a folder of its own, so that a batch that runs again replaces what it wrote.

Folders add up, so they are folded now and then. A table that grows with the stream gets a *segment*, of the batches since the
fold before, so each row is written twice whatever the table's length; a table whose rows ``change`` keeps bounded is folded
into one again. A fold is written aside and noted in a log, with the batch that it begins after, when it is complete; what
it made superfluous goes one fold later. Readers follow the log from the last fold back and add the batches after it,
hence find every row once whether they come before, during or after a fold, and a fold that failed is as if it had not begun.
A table is only ever written by its stream, whose batches come in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import read_or_empty
from tidemark.sources.sinks import _file_system, remove

#: Batches after which folders are folded.
FOLD_EVERY = 256


def folds(spark: SparkSession, path: str) -> dict[int, int]:
    """The complete folds, ascending: the last batch of each, and the batch that it begins after (-1: it has all before)."""
    log = read_or_empty(spark, f"{path}/_folds", "upto long, since long").collect()  # a row for each fold
    return dict(sorted((r["upto"], r["since"]) for r in log))


def _chain(found: dict[int, int], upto: int | None) -> list[int]:
    """The folds that together hold all batches up to the last fold that is not after ``upto``, ascending."""
    chain, at = [], max((f for f in found if upto is None or f <= upto), default=-1)
    while at >= 0:
        chain.append(at)
        at = found[at]
    return chain[::-1]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def read(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """All rows of batches up to ``upto``, with their ``batch_id``: the batch, or the last of the fold for rows that are folded."""
    chain = _chain(folds(spark, path), upto)
    return _rows(spark, path, schema, chain, chain[-1] if chain else -1, upto)


def _rows(spark: SparkSession, path: str, schema: str, chain: list[int], after: int, upto: int | None) -> DataFrame:
    numbers = [n for n in _numbers(spark, path) if n > after and (upto is None or n <= upto)]
    parts = [f"{path}/_folded/upto={f}" for f in chain] + [f"{path}/batch_id={n}" for n in numbers]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(-1).cast("long"))
    rows = spark.read.schema(schema).parquet(*parts)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"(?:batch_id|upto)=(\d+)/[^/]*$", 1).cast("long")
    return rows.withColumn("batch_id", number)


def write(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def fold(spark: SparkSession, path: str, schema: str, upto: int, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Fold the batches up to ``upto``, into a segment, or together with all before into what ``change`` keeps of them. A fold
    that is in the log stays as it is."""
    found = folds(spark, path)
    if upto in found:
        return
    earlier = [f for f in found if f < upto]
    last = earlier[-1] if earlier else -1
    if change:
        rows, since = change(_rows(spark, path, schema, _chain(found, last), last, upto).drop("batch_id")), -1
    else:
        rows, since = _rows(spark, path, schema, [], last, upto).drop("batch_id"), last
    rows.write.mode("overwrite").parquet(f"{path}/_folded/upto={upto}")
    spark.createDataFrame([(upto, since)], "upto long, since long").coalesce(1).write.mode("append").parquet(f"{path}/_folds")
    # readers of the fold before still find its batches and itself
    remove(spark, *[f"{path}/_folded/upto={f}" for f in (earlier[:-1] if change else [])], *[f"{path}/batch_id={n}" for n in _numbers(spark, path) if n <= last])
