"""Every registered query against DuckDB, and a look at its plan."""

import pytest

import __spark_entry__ as entry
from groundline import catalogue
from tests.compare import connect, differences

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert differences(df, con, SQL[name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
