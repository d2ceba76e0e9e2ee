"""Every registered query against its SQL twin."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from tests.conftest import SMALL
from tidemark import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v) if isinstance(v, (datetime.date, int, str)) else v


def test_every_query_has_a_twin():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_twin(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    ours = sorted(([_plain(v) for v in r] for r in df.select(*names).collect()), key=str)
    result = duck.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    assert ours == sorted(([_plain(r[i]) for i in at] for r in result.fetchall()), key=str)
