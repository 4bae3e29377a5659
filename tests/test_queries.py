"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from waymark.plans import queries as base


def canon(rows, columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, duck, name):
    got = base.QUERIES[name](spark, SF)
    if name not in base.SQL:
        assert got.count() > 0
        return
    want = duck.sql(base.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert canon([r.asDict() for r in got.collect()], columns) == canon(rows, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
