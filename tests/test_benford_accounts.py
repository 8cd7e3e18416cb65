"""The digit law within single accounts."""

from tallyspark.plans import registry

from .oracle import connect, same

DIR = "/root/testdata/sf0.1"


def test_accounts_of_companies(spark):
    q = registry.queries()["benford_accounts"]
    same(spark, connect(DIR), q, registry.oracle_sql()["benford_accounts"], DIR)
    got = q(spark, DIR).collect()
    assert len(got) > 4 and all(r["digits"] for r in got if r["deviates"])
