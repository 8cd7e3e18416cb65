"""Every registered query of the core against its SQL; those without SQL must run and give their columns."""

import pytest

from tallyspark.plans import registry

from .oracle import DIR, connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        same(spark, con, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, DIR)
        assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
