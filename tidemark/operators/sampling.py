"""Exact-quota stratified samples and full shuffles, deterministic for a seed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import age_group, first_word, free_name
from tidemark.operators.indexing import with_row_index
from tidemark.operators.quality import require_columns

#: Fixed shares of the age groups.
AGE_RATIOS = {"20s": 0.05, "30s": 0.09, "40s": 0.11, "50s": 0.14, "60s": 0.15, "70+": 0.46}

#: Hexadecimal digits of a hash that the histogram of a stratum counts: 65,536 rows for each stratum.
HISTOGRAM_DIGITS = 4


def normalize_persona(df: DataFrame, text_col: str = "persona") -> DataFrame:
    """``gender`` becomes ``sex`` and the text column ``persona``; the age group and the name follow from age and text."""
    names = {old: new for old, new in {"gender": "sex", text_col: "persona"}.items() if old in df.columns and new not in df.columns}
    df = df.withColumnsRenamed(names)
    require_columns(df, ["sex", "age", "persona"])
    age = F.col("age").try_cast("int")
    return df.withColumns({"age": age, "age_group": age_group(age), "customer_name": first_word("persona")})


def quotas(n: int, ratios: Mapping[str, float] = AGE_RATIOS, rest: str = "70+") -> dict[str, int]:
    """Whole shares of n, rounded down; what is left goes to ``rest``."""
    found = {k: int(n * r) for k, r in ratios.items()}
    found[rest] += n - sum(found.values())
    return found


def shuffle_key(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def quota_sample(df: DataFrame, stratum: str, key: str, wanted: Mapping[str, int], seed: int = 42) -> DataFrame:
    """Exactly the wanted number of rows of each stratum, with ``slot`` from 0.

    Rows are ranked by a seeded hash of their key. A histogram of the hashes' first digits finds how far the quota of each
    stratum reaches, so only those rows are shuffled and ranked, by a row index over all strata at once that spreads a large
    one over tasks. A stratum smaller than its quota is read over from the start, so that each row is used as often as any
    other, give or take one. Strata of the quota that have no rows raise ValueError.
    """
    asked = {k: n for k, n in wanted.items() if n > 0}
    shuffle, place, digits = (free_name(df, n, "slot") for n in ("shuffle", "place", "digits"))
    keyed = df.where(F.col(stratum).isin(*asked)).withColumn(shuffle, shuffle_key(key, seed)).withColumn(digits, F.substring(shuffle, 1, HISTOGRAM_DIGITS))
    histogram = keyed.groupBy(stratum, digits).count()
    upto = F.sum("count").over(Window.partitionBy(stratum).orderBy(digits).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number_of = lambda d, c: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(c)]
    reached = histogram.select(stratum, digits, "count", upto.alias("upto"))
    last = F.min(F.when(F.col("upto") >= number_of(asked, stratum), F.col(digits))).alias("last")
    found = reached.groupBy(stratum).agg(F.sum("count").alias("n"), last).collect()  # a row for each stratum
    sizes = {r[stratum]: r["n"] for r in found}
    if empty := [k for k in asked if k not in sizes]:
        raise ValueError(f"no rows in {', '.join(empty)}")
    number = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(stratum)]
    # a row at place p fills the slots p, p + size, p + 2 size ... below the quota
    bounds = {r[stratum]: r["last"] if r["last"] is not None else "g" for r in found}  # beyond all hexadecimal digits
    taken = keyed.where(F.col(digits) <= number(bounds)).drop(digits)
    counts = {r[stratum]: r["n"] for r in reached.where(F.col(digits) <= number(bounds)).groupBy(stratum).agg(F.sum("count").alias("n")).collect()}
    indexed = with_row_index(taken, stratum, shuffle, key, name=place).drop(shuffle)
    starts = {k: sum(counts[x] for x in counts if x < k) for k in counts}
    ranked = indexed.withColumn(place, F.col(place) - number(starts) - 1).where(F.col(place) < number(asked))
    return ranked.withColumn("slot", F.explode(F.sequence(F.col(place).cast("long"), number(asked).cast("long") - 1, number(sizes).cast("long")))).drop(place)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Adds each row's place, from 1, in a full shuffle; ties go by ``key``."""
    shuffle = free_name(df, "shuffle", name)
    return with_row_index(df.withColumn(shuffle, shuffle_key(key, seed)), shuffle, key, name=name).drop(shuffle)


def shares(df: DataFrame, by: str) -> DataFrame:
    """How large a part of all rows each value has."""
    counts = df.groupBy(by).count()
    everything = F.sum("count").over(Window.partitionBy())
    return counts.select(by, (F.col("count").cast("double") / everything).alias("share"))
