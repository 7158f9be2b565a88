"""Every core query against DuckDB on the same tables."""

import glob
import math
from decimal import Decimal

import duckdb
import pytest

from asofledger.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return float(value) if isinstance(value, Decimal) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(map(normal, r)) for r in got.select(*names).collect()), key=repr)
    assert rows == sorted((tuple(map(normal, r)) for r in duck.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
