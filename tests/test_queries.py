"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tideline.plans import diary, oracles, scans
from tideline.plans.queries import queries

DIR = "/root/testdata/sf0.001"


def oracle_sql():
    return oracles.oracle_sql() | diary.oracle_sql() | scans.oracle_sql()


def cells(rows):
    out = [tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, db, name):
    df = queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = db.execute(oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert cells([tuple(r[c] for c in columns) for r in df.collect()]) == cells([tuple(r[k] for k in order) for r in found.fetchall()])


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
