"""Queries against their SQL."""

from __future__ import annotations

import pytest
from test_entry import duck, value  # noqa: F401

from wrackline.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):  # noqa: F811
    found = queries.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    got = sorted((tuple(value(r[c]) for c in names) for r in found.collect()), key=str)
    sql = duck.execute(oracles.ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted((tuple(value(r[i]) for i in order) for r in sql.fetchall()), key=str)
