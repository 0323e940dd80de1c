"""The named queries against their SQL counterparts at the smallest scale."""

from __future__ import annotations

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert len(found) > 0
    assert difference(found, duck.execute(SQL[name]).df()) is None


def test_entry(spark):
    summary = entry_module.entry(spark)
    assert summary.count() == 15
    assert "duration_minutes" in summary.columns
