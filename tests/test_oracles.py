"""Every registered query against its SQL twin, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from relgraph.plans.registry import TABLES

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def text(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def normal(frame):
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in ordered.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda df: df.astype(object).where(df.notna(), None)
    assert normal(clean(got)) == normal(clean(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
