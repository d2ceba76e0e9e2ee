"""Checks of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def profile(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: table, rows, rows with a null in the key, rows that repeat a key."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    agg = [F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~null, F.col("n") - 1)), F.lit(0))]
    return by_key.agg(*[a.cast("long").alias(c) for a, c in zip(agg, ("row_count", "null_key_count", "duplicate_key_count"), strict=True)]).select(F.lit(name).alias("table_name"), "*")


def check(profiles: DataFrame) -> None:
    """Raises if a table of the profile is empty or has null or repeated keys; there is a row for each table."""
    bad = profiles.where((F.col("row_count") == 0) | (F.col("null_key_count") > 0) | (F.col("duplicate_key_count") > 0)).collect()
    if bad:
        raise ValueError("; ".join(f"{r['table_name']}: {r['row_count']} rows, {r['null_key_count']} null keys, {r['duplicate_key_count']} repeated" for r in bad))


def sample(df: DataFrame, n: int) -> DataFrame:
    """A few rows to look at."""
    return df.limit(n)
