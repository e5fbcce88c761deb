"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as e

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = e.queries(), e.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() >= 0 and df.columns


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert e.entry(spark).count() > 0
