import pytest

from tallyspark.llm import queries as q

from ..oracle import DIR, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, con, name):
    if name in q.oracle_sql():
        same(spark, con, q.queries()[name], q.oracle_sql()[name])
    else:
        assert q.queries()[name](spark, DIR).count() > 0
