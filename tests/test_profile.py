import math

from tallyspark.operators import profile
from tallyspark.session import new_path

SCHEMA = "load string, s string, d double, k int, n long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def keyed(df):
    return {(r["load_id"], r["column_name"]): r for r in df.collect()}


def test_metrics_are_exact(spark):
    rows = [("a", "x", 1.0, 1, None), ("a", "x", float("nan"), 1, None), ("a", None, None, 2, None), ("a", "y", -4.0, 3, 9), (None, "x", 1.0, 1, 1)]
    m = keyed(profile.metrics(profile.value_counts(table(spark, rows), "load")))
    r = m["a", "s"]
    assert (r["row_count"], r["nulls"], r["distinct_count"]) == (4, 1, 2)
    assert math.isclose(r["entropy"], -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))
    assert (m["a", "d"]["distinct_count"], m["a", "d"]["min_num"]) == (3, -4.0)
    assert (m["a", "n"]["nulls"], m["a", "n"]["distinct_count"]) == (3, 1)
    assert m[None, "k"]["row_count"] == 1


def test_median_position(spark):
    values = [0.0, -5.0, 1.0, 2.0, 2.0, 1e9, None, float("nan")]
    c = profile.value_counts(table(spark, [("a", None, v, 1, 1) for v in values]), "load")
    assert profile.medians(c, ["d"]).first()["median_abs"] == 2.0
    even = profile.value_counts(table(spark, [("a", None, v, 1, 1) for v in (1.0, 2.0, 3.0, 4.0)]), "load")
    assert profile.medians(even, ["d"]).first()["median_abs"] == 2.0


def test_signed_deltas(spark):
    store = profile.ValueCountStore(spark, new_path(spark, "t"))
    a, b = table(spark, [("a", "x", 1.0, 1, 1), ("a", "y", 1.0, 1, 1)]), table(spark, [("a", "x", 1.0, 1, 1)])
    store.apply(profile.value_counts(a, "load"))
    store.apply(profile.value_counts(b, "load"))
    store.apply(profile.value_counts(a, "load"), sign=-1)
    want = {(r["column_name"], r["s"], r["d"], r["i"], r["n"]) for r in profile.value_counts(b, "load").collect()}
    assert {(r["column_name"], r["s"], r["d"], r["i"], r["n"]) for r in store.current().collect()} == want
    assert store.compact().current().count() == len(want)
    assert profile.ValueCountStore(spark, store.path).deltas == 3


def test_sync_keeps_up_with_the_table(spark):
    path = new_path(spark, "t")
    rows = [("a", "x", 1.0, 1, 1), ("b", "y", 2.0, 1, 1), (None, "z", 3.0, 1, None)]
    counts = lambda df: {tuple(r) for r in df.select("load_id", "column_name", "s", "d", "i", "n").collect()}
    cols = ["s", "d", "k", "n"]
    for step, t in enumerate((rows, rows, [rows[0], ("b", "y", 9.0, 1, 1), rows[2], ("c", None, None, 1, 1)], rows[1:], [])):
        df = table(spark, t)
        store = profile.ValueCountStore(spark, path).sync(df, "load", cols)
        assert counts(store.current()) == counts(profile.value_counts(df, "load", cols)), step
        assert store.deltas == (1, 1, 3, 5, 6)[step]  # nothing is counted again that has not changed


def test_empty(spark):
    c = profile.value_counts(table(spark, []), "load")
    assert c.count() == 0 and profile.metrics(c).count() == 0


def test_catalog_measures(spark):
    t = [("a", "K1", 1.0, 1, 1)] * 9 + [("a", None, 100.0, 5, 1)] + [("b", "Z", 1000.0, 20, 1)] * 10
    df = table(spark, t)
    cat = spark.createDataFrame(
        [("E", 1, "a", "s", "object", 0.1, 1, "^K[0-9]$", None, None), ("E", 2, "b", "s", "int64", 0.0, 9, "^K[0-9]$", None, None), ("E", 1, "a", "d", "float64", None, 2, None, 0.0, 50.0), ("E", 2, "b", "d", "float64", 0.5, 1, None, 0.0, 5000.0), ("E", 2, "b", "absent", "object", 0.5, 1, None, None, None)],
        "engagement_id string, load_no int, upload_batch_id string, column_name string, dtype string, null_rate double, distinct_count long, value_pattern string, min_value double, max_value double",
    )
    got = {tuple(r) for r in profile.check_catalog(profile.value_counts(df, "load"), cat, df.drop("load").schema).collect()}
    assert got == {("b", "s", "dtype"), ("b", "s", "distinct_count"), ("b", "s", "pattern"), ("b", "s", "domain_shift"), ("a", "d", "range"), ("b", "d", "null_rate"), ("b", "d", "median_shift")}
