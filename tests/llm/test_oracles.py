"""Operators that SQL can express against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, sf).select(columns).collect())) == sorted(found.fetchall())
