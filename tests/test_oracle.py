"""Every registered query against DuckDB on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry_and_names(spark):
    assert set(SQL) <= set(queries())
    assert entry(spark).count() > 0
