"""Stages of duplicate payments."""

from tallyspark.operators import rules
from tallyspark.plans import registry

from .oracle import connect, same

DIR = "/root/testdata/sf0.1"


def test_kinds_on_a_larger_ledger(spark):
    same(spark, connect(DIR), registry.queries()["duplicate_payment_kinds"], registry.oracle_sql()["duplicate_payment_kinds"], DIR)


def test_each_kind(spark):
    rows = [
        ("a1", "A", "2023-01-01", 1000.0, "R1"), ("a2", "A", "2024-06-01", 1010.0, "r-1"),  # reference, however far back
        ("b1", "B", "2023-01-01", 1000.0, "R2"), ("b2", "B", "2024-06-01", 1000.0, None),  # mixed, without a window
        ("c1", "C", "2023-01-01", 1000.0, "R3"), ("c2", "C", "2023-03-01", 990.0, "R4"), ("c3", "C", "2023-12-01", 990.0, "R5"),  # amount, c3 beyond the window
        ("d1", "D", "2023-01-01", 1000.0, None), ("d2", "D", "2023-03-01", 1000.0, None),  # blank
        *((f"e{k}", "E", f"2023-0{k}-01", 500.0, f"S{k}") for k in range(1, 8)), ("e8", "E", "2023-07-05", 500.0, "S8"),  # recurring, with a manual extra
    ]
    docs = spark.createDataFrame([(i, "C1", p, t, a, r, i == "e8") for i, p, t, a, r in rows], "document_id string, company_code string, partner string, t string, amount double, reference string, manual boolean")
    got = rules.duplicate_payment_matches(docs.selectExpr("*", "cast(t as timestamp_ntz) as posting_date")).collect()
    assert {(r["document_id"], r["earlier"], r["kind"]) for r in got} == {("a2", "a1", "reference"), ("b2", "b1", "mixed"), ("c2", "c1", "amount"), ("d2", "d1", "blank"), ("e8", "e7", "near_extra")}
