"""Every query with a SQL counterpart gives the same rows as DuckDB on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, bool):
        return str(v)
    # Two engines may round a value in the last printed place differently.
    return f"{float(v):.5g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, rel.fetchall())
    assert got == want


def test_every_query_is_registered():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
