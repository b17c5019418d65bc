"""The entry module: every query of the library runs, and agrees with its SQL where it has some."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from wrackline.plans import registry


def value(x):
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None if x is None else str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    got = sorted((tuple(value(r[c]) for c in names) for r in found.collect()), key=str)
    sql = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted((tuple(value(r[i]) for i in order) for r in sql.fetchall()), key=str)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
