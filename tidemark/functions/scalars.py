"""Column expressions shared by the operators. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amount(c: str | Column) -> Column:
    """Money as an exact decimal, so that sums do not depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,6)")


def total(c: str | Column, digits: int | None = 2) -> Column:
    """Exact sum of money, half up to ``digits``, as a double."""
    s = F.sum(amount(c))
    return (F.round(s, digits) if digits is not None else s).cast("double")


def rounded(c: Column, digits: int) -> Column:
    """Half up on the decimal value of a double (never on its binary one)."""
    return F.round(c.cast("decimal(38,8)"), digits).cast("double")


def ratio(a: Column, b: Column, digits: int) -> Column:
    """a / b rounded; null where b is 0."""
    return rounded(F.try_divide(a.cast("double"), b.cast("double")), digits)


def mean(c: str | Column, digits: int = 2) -> Column:
    """Average of the values that are not null, from an exact sum."""
    return ratio(F.sum(amount(c)), F.count(c), digits)


def month_of(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def event_time_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def key_hash(c: str | Column) -> Column:
    """The first 32 bits of the md5 of a key, as other SQL engines can compute it too."""
    return F.conv(F.substring(F.md5(F.col(c) if isinstance(c, str) else c), 1, 8), 16, 10).cast("long")


def age_group(age: str | Column) -> Column:
    """Decades from the twenties (and below) to 70+; null stays null."""
    a = F.col(age) if isinstance(age, str) else age
    out = F.when(a.isNull(), F.lit(None).cast("string"))
    for bound in range(30, 80, 10):
        out = out.when(a < bound, f"{bound - 10}s")
    return out.otherwise("70+")


def first_word(text: str | Column) -> Column:
    """The first token between white space; null for an empty text."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.nullif(F.regexp_extract(t, r"^(\S+)", 1), F.lit(""))


def first_filled(*names: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def timestamp_or_null(c: str | Column, ntz: bool = False) -> Column:
    """Text or timestamp to timestamp; what cannot be read is null. Columns that are timestamps pass through by a cast."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("timestamp_ntz" if ntz else "timestamp")


def free_name(df: DataFrame, stem: str, *taken: str) -> str:
    """A name for a helper column that neither ``df`` nor ``taken`` has."""
    names = {c.lower() for c in (*df.columns, *taken)}
    name = f"_{stem}"
    while name.lower() in names:
        name += "_"
    return name
