"""Every registered query that isn't of the llm folder: against its SQL where it has one, else that it gives rows."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from verdigris.plans import registry
from verdigris.plans.fixtures import TABLES

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries whose result is empty on these tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, (decimal.Decimal, float)):
        return int(value) if value == value and value == int(value) else round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    elif name not in EMPTY:
        assert rows
