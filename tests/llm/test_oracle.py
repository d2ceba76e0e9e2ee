"""The queries that have one against their SQL twin."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SMALL
from tidemark.llm import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(result.fetchall(), key=str)
