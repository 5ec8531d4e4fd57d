"""Every query that SQL can express gives the rows of its SQL."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

import postlake.plans  # noqa: F401
from postlake.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6)
    return str(v)[:19] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = duck.sql(ORACLE[name])
    at = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(found.columns) == columns
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
