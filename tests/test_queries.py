"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from veldspan.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    twin = duck.sql(registry.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    want = sorted((tuple(plain(float(r[i])) if type(r[i]).__name__ == "Decimal" else plain(r[i]) for i in at) for r in twin.fetchall()), key=repr)
    assert got == want
