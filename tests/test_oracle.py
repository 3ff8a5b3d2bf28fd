"""Every query that has reference SQL, compared by name, type and value."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry_point
from conftest import SMALL

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_reference_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) == []


def test_entry_is_the_feature_table(spark):
    df = entry_point.entry(spark)
    assert len(df.columns) == 102 and df.count() == 93
