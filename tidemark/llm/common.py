"""What the operators share: the input tables, the shared work folder, pinned intermediate tables and names of helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import remove

_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent in a local session, as in tests, a temporary folder is used and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = workdir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.pinned_at = path
    if _scopes:
        _scopes[-1].append(path)
    return made


class Scope:
    """What was pinned since :func:`temporary` began."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def keep(self, df: DataFrame) -> DataFrame:
        """A pinned table that stays; an enclosing scope may still let go of it."""
        self.paths.remove(df.pinned_at)
        if len(_scopes) > 1:
            _scopes[-2].append(df.pinned_at)
        return df

    def keep_all(self) -> None:
        if len(_scopes) > 1:
            _scopes[-2].extend(self.paths)
        self.paths.clear()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """Tables pinned inside are deleted at the end but for those that are kept: whatever is still to run may read only these.
    After an error all stay as they are."""
    _scopes.append([])
    scope = Scope(_scopes[-1])
    try:
        yield scope
        remove(spark, *scope.paths)
    finally:
        _scopes.pop()


def unpin(*tables: DataFrame) -> None:
    """Delete tables that :func:`pin` made, once nothing that is still to run reads them; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "pinned_at", None):
            remove(df.sparkSession, path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path within it; usable on the driver and inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def free_name(df: DataFrame, stem: str, *taken: str) -> str:
    """A name for a helper column that neither a column of ``df`` nor ``taken`` has; names differ by more than case."""
    names = {c.lower() for c in (*df.columns, *taken)}
    name = f"_{stem}"
    while name.lower() in names:
        name += "_"
    return name


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, to tell rows apart alike at every run; those that cannot be hashed as they are go by their JSON text."""
    odd = lambda t: "map<" in t or "variant" in t
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if odd(f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in df.schema])
