"""Every registered query against its SQL in DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

FOLDER = entry.SMOKE_FOLDER


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 25
