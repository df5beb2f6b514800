"""Every query of plans against its SQL in DuckDB."""

import pytest

from loamgrid.plans import all_queries, all_sql

from .oracle import compare, connection

SF = "/root/testdata/sf0.01"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    more, less = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert not more and not less, (list(more)[:3], list(less)[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
