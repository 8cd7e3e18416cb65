import datetime as dt

from tallyspark.operators import orphans, skew


def test_heavy_keys_and_totals(spark):
    rows = [("hot", 1.0)] * 600 + [("warm", 2.0)] * 90 + [(None, 5.0)] * 10 + [(f"k{i}", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    assert {tuple(r) for r in skew.dominant_keys(df, ["k"], 0.05).collect()} == {("k", "hot"), ("k", "warm")}
    got = {r["key_value"]: (r["n_rows"], r["sum_v"], r["is_heavy"]) for r in skew.totals_by_key(df, "k", ["v"], 0.05).collect()}
    assert got["hot"] == (600, 600.0, True) and got["warm"] == (90, 180.0, True) and got["k3"] == (1, 1.0, False) and len(got) == 302
    empty = df.limit(0)
    assert skew.totals_by_key(empty, "k", ["v"]).count() == 0 and skew.dominant_keys(empty, ["k"]).count() == 0


def test_share_counts_all_rows(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 95, "k string")
    assert skew.dominant_keys(df, ["k"], 0.05).count() == 1
    assert skew.dominant_keys(df.unionByName(spark.createDataFrame([(None,)], "k string")), ["k"], 0.05).count() == 0


def test_orphans(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    ref = orphans.Reference("t", "fk", "at", "p", "id")
    parent = spark.createDataFrame([("A", "open", day(1)), (" b ", "De leted", day(1)), ("C", "open", day(20)), ("D", "deleted", day(1)), ("d", "open", day(9)), ("E", None, None), (None, "open", day(1))], "id string, status string, created_at timestamp_ntz")
    child = spark.createDataFrame(
        [(1, " a", day(2), day(2)), (2, "B", day(2), day(2)), (3, "c", day(2), day(2)), (4, "c", day(25), None), (5, "x", day(2), day(3)), (6, None, day(2), day(2)), (7, "  ", day(2), day(2)), (8, "D", day(10), day(2)), (9, "D", day(2), day(2)), (10, "e", day(1), day(2)), (11, "X ", None, None)],
        "row_id long, fk string, created_at timestamp_ntz, at timestamp_ntz",
    )
    got = {tuple(r) for r in orphans.orphans(child, parent, ref).select("row_id", "ref_period", "reason").collect()}
    assert got == {(2, "2024-01", "deleted"), (3, "2024-01", "late"), (5, "2024-01", "missing"), (9, "2024-01", "late"), (11, "unknown", "missing")}
    assert orphans.orphans(child, parent.limit(0), ref).count() == 9
    assert orphans.orphans(child.limit(0), parent, ref).count() == 0
