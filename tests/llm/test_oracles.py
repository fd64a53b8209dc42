"""The corpus queries that have SQL against it in DuckDB, over the smallest tables, where these are there."""

from __future__ import annotations

import os

import duckdb
import pytest

from factloom.llm import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "conversations")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{DIR}/documents.parquet"), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DIR), duck.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def plain(rows):
        return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows], key=repr)

    rows = plain(got.select(*columns).collect())
    assert rows and rows == plain(want.select(*columns).fetchall())
