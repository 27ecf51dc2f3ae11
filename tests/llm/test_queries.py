"""Registered corpus queries against their SQL statements, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from tests.compare import difference
from zealmark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert difference(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) is None


def test_all_are_registered():
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 14)]
