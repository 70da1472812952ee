"""Registered queries against DuckDB on the smallest tables."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from lathe.plans import registry
from lathe.session import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert name in ORACLES
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    expected = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
