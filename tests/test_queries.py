"""Every named query against its SQL, and the contract of the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from veclume.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, db, name):
    frame = QUERIES[name](spark, sf)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(_plain, r)) for r in frame.select(*columns).collect())
    assert got and got == sorted(tuple(map(_plain, r)) for r in want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "id", "score", "rank"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
