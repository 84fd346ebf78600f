"""Every registered query against its oracle SQL in DuckDB, and the entry points."""

from __future__ import annotations

import math

import duckdb
import pytest

from quarry.plans.all_queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return repr(value) if isinstance(value, float) else str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def retired_documents(spark, folder):
    """Dated and undated documents (undated: doc_id % 11 = 0) that each name one word."""
    rows = [(n, f"such a {word} it was", "en", "src1", 20) for n, word in enumerate(["moron", "clown", "trash", "scum", "moron", "Clown"] * 22)] + [(11_000, None, "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def test_retired_claims_of_undated_texts_equal_their_sql(spark, tmp_path):
    con = retired_documents(spark, tmp_path)
    found = {(r.doc_id, r.retirement) for r in QUERIES["retired_claims"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(ORACLE_SQL["retired_claims"]).fetchall()) and (0, None) in found


def test_retired_records_of_undated_texts_equal_their_sql(spark, tmp_path):
    con = retired_documents(spark, tmp_path)
    found = {(r.doc_id, r.role, r.nth) for r in QUERIES["retired_records"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(ORACLE_SQL["retired_records"]).fetchall()) and len(found) > 10
