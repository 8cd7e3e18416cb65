"""Shifts and drift of every period of a ledger, over more than one year."""

import pytest

from tallyspark.plans import registry

from .oracle import connect, same

NAMES = ("activity_shift", "shape_shift", "drift_numeric", "drift_categorical")
YEARS = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def con():
    return connect(YEARS)


@pytest.mark.parametrize("name", NAMES)
def test_periods_over_two_years(spark, con, name):
    same(spark, con, registry.queries()[name], registry.oracle_sql()[name], YEARS)


def test_every_period_but_the_first_is_compared(spark):
    got = registry.queries()["drift_numeric"](spark, YEARS).collect()
    assert {(r["unit"], r["period"]) for r in got} == {("year", 2024), ("half", 20232), ("half", 20241), ("half", 20242)}


def test_an_account_first_used_later_is_new(spark, tmp_path):
    rows = "select 1L as row_id, 2023 as fiscal_year, timestamp_ntz'2023-03-01' as posting_date, 'd1' as document_id, '100000' as gl_account, 5.0d as debit_amount, 0.0d as credit_amount"
    later = "2L, 2024, timestamp_ntz'2024-11-01', 'd2', '200000', 5.0d, 0.0d"
    spark.sql(f"{rows} union all select {later}").write.parquet(f"{tmp_path}/general_ledger.parquet")
    got = registry.queries()["activity_shift"](spark, str(tmp_path)).collect()
    assert {(r["unit"], r["period"], r["gl_account"], r["is_new"]) for r in got} == {("year", 2024, "200000", True), ("half", 20242, "200000", True)}
