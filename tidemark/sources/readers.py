"""Table readers: CSV, Parquet, JSON lines and tables that may not exist yet. Paths are URIs; the session has their settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import timestamp_or_null
from tidemark.sources.sinks import current


def files_with_open_quotes(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of a CSV table that need no reader of many lines, and those that do: a quoted field that runs over a line's end
    leaves lines with an odd number of quotes. Lines are counted by all tasks; a row for each file comes to the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    found = lines.groupBy("file").agg(F.max(F.col("quotes") % 2).alias("open")).orderBy("file").collect()
    return [r["file"] for r in found if not r["open"]], [r["file"] for r in found if r["open"]]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold newlines and doubled quotes. Types are inferred without a schema.

    A file with quoted newlines is read as a whole by one task, as it must be; all others are split among tasks. Where the types
    inferred for the two kinds of files differ, a column is text.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    split, whole = files_with_open_quotes(spark, path)
    if not split and not whole:  # empty files
        return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    kinds = [(files, many) for files, many in ((split, False), (whole, True)) if files]
    if schema is None:
        inferred = [reader.option("multiLine", many).option("inferSchema", True).csv(files).schema for files, many in kinds]
        schema = inferred[0] if all(s == inferred[0] for s in inferred) else T.StructType([f if all(f.name in s.names and s[f.name] == f for s in inferred) else T.StructField(f.name, T.StringType()) for f in inferred[0]])
    parts = [reader.option("multiLine", many).schema(schema).csv(files) for files, many in kinds]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def coerce_timestamps(df: DataFrame, *names: str) -> DataFrame:
    """Text columns to timestamps without a zone; what cannot be read becomes null."""
    return df.withColumns({n: timestamp_or_null(n, ntz=True) for n in names})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table, or the Parquet files of a plain folder."""
    return spark.read.parquet(current(spark, path) or path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at ``path``, or an empty one of this schema if the path is missing or holds no file."""
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def read_event_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Events from JSON lines; blank lines and events without a time are left out."""
    return spark.read.schema(schema).json(path).where(F.col("event_time").isNotNull())
