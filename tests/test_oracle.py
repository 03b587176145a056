"""Every registered query against its SQL form on the smallest data set."""

import pytest

import __spark_entry__ as entry
from duckcheck.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_matches_sql(spark, connection, name):
    result = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert result.count() >= 0
    else:
        assert differences(result, connection, sql) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 8
