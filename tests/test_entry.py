"""Every registered query of the lead-data part equals its oracle, and the entry point holds to its contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalog, decisions, extra, markups, merges, more, planning, recorded  # noqa: F401
from brindle.plans.views import VIEWS, view


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted([plain(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_have_rows(spark, sf, name):
    assert view(spark, sf, name).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
