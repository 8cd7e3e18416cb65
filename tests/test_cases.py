"""Cases, bands, evaluation, model preparation and state on small hand-made frames, with ties, nulls, repeated rows and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark import functions, session
from tallyspark.operators import cases, learn, scoring, sinks, skew, timeseries
from tallyspark.session import new_path
from tallyspark.sources import mapping, sidecars


def test_chains_of_any_length(spark):
    pairs = [(f"d{k:03}", f"d{k - 1:03}") for k in range(1, 70)] + [("x2", "x1"), ("x2", "x1"), ("y2", "x1")]
    got = {r["document_id"]: r["root"] for r in cases.chains(spark.createDataFrame(pairs, "document_id string, earlier string")).collect()}
    assert got == {f"d{k:03}": "d000" for k in range(70)} | {"x1": "x1", "x2": "x1", "y2": "x1"}
    assert cases.chains(spark.createDataFrame([], "document_id string, earlier string")).count() == 0


def test_bands(spark):
    df = spark.createDataFrame([(k, float(100 - k)) for k in range(99)] + [(99, None), (100, -1.0), (101, 100.0)], "k int, s double")
    got = {r["k"]: r["band"] for r in cases.rank_bands(df, "k", "s").collect()}
    assert got[0] == got[101] == "immediate" and got[1] == "review" and got[10] == "candidate" and got[30] == "none" and got[99] == got[100] == "none" and len(got) == 102
    rows = [("immediate", "immediate"), ("immediate", None), ("none", "review"), ("candidate", "none"), (None, None)]
    x = spark.createDataFrame(rows, "a string, b string").select(cases.joint_band("a", "b").alias("c")).collect()
    assert [r["c"] for r in x] == ["immediate", "review", "review", "candidate", "none"]


def test_recall_keeps_ties(spark):
    rows = [("g", "fraud" if k < 3 else None, 1.0 if k < 5 else 0.1, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g string, scenario string, s double, k int")
    r = cases.recall_at_k(df, "g", "scenario", "s", 0.01, 5).collect()
    assert len(r) == 1 and (r[0]["n_truth"], r[0]["n_hit"], r[0]["k"], r[0]["fold_size"]) == (3, 3, 1, 100)
    b = cases.bootstrap(spark.createDataFrame([("a", 100, 50), ("b", 4, 0)], "scenario string, n_truth long, n_hit long")).collect()
    assert b[0]["ci_lo"] < 0.5 < b[0]["ci_hi"] and not b[0]["insignificant"] and b[1]["ci_hi"] == 0.0
    assert cases.recall_at_k(df.limit(0), "g", "scenario", "s").count() == 0


def test_levels_and_floors(spark):
    s = spark.createDataFrame([(k, k / 100) for k in range(0, 100)] + [(100, 0.0)], "row_id int, anomaly_score double")
    got = {r["row_id"]: r["risk_level"] for r in scoring.quantile_levels(s).collect()}
    assert got[99] == "High" and got[80] == "Medium" and got[60] == "Low" and got[10] == got[0] == got[100] == "Normal"
    f = spark.createDataFrame([(1, "L1-04", 1.0), (2, "L1-04", 0.5)], "row_id int, rule_id string, score double")
    up = {r["row_id"]: r for r in scoring.policy_floors(s.withColumn("risk_level", F.lit("Normal")), f).collect()}
    assert up[1]["risk_level"] == "High" and up[1]["anomaly_score"] == 0.5 and up[2]["risk_level"] == "Normal" and up[2]["reasons"] == ""


def test_quantiles_are_exact(spark):
    rnd = random.Random(1)
    v = [rnd.choice([rnd.random() * 1e6, -5.0, 0.0, 7.0]) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "v double").repartition(5)
    want = df.filter("v is not null and not isnan(v)").agg(F.expr("percentile(v, array(0.1, 0.5, 0.95))")).first()[0]
    got = functions.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.95}).first()
    assert all(math.isclose(x, y) for x, y in zip(got, want, strict=True))
    assert functions.quantiles(df.limit(0), "v", {"a": 0.5}).first()["a"] is None


def test_lookups_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "is_small", lambda df, *a: False)
    df = spark.createDataFrame([("hot", k) for k in range(500)] + [(f"k{k}", k) for k in range(50)] + [(None, 1)], "k string, v int")
    t = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("zz", "z")], "k string, w string")
    count = lambda how: skew.joined_by_key(df, t, ["k"], how, share=0.1).count()
    assert [count(h) for h in ("inner", "left", "left_semi", "left_anti")] == [501, 551, 501, 50]
    assert skew.joined_by_key(df, t, ["k"], "left", share=0.1).filter("k = 'hot' and w = 'H'").count() == 500


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)


def test_cached_tables_follow_their_files(spark, tmp_path):
    at, made = str(tmp_path / "in"), []

    def make():
        made.append(1)
        return spark.read.parquet(at)

    spark.range(3).write.parquet(at)
    assert session.cached(spark, "t", [at], make).count() == session.cached(spark, "t", [at], make).count() == 3 and len(made) == 1
    spark.range(2).write.mode("append").parquet(at)
    assert session.cached(spark, "t", [at], make).count() == 5 and len(made) == 2


def test_powers_and_weights(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(math.exp(rnd.gauss(3, 1)),) for _ in range(2000)] + [(None,)], "v double")
    assert abs(learn.best_power(df, "v")) <= 0.2  # log-normal values ask for the logarithm
    assert learn.best_power(df.limit(0), "v") is None and learn.best_power(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v") is None
    x = spark.createDataFrame([(a, b, 2 * a - b) for a, b in ((rnd.random(), rnd.random()) for _ in range(500))], "a double, b double, y double")
    w = learn.nonnegative_weights(x, ["a", "b"], "y", ridge=1e-6)
    assert w[1] == 0.0 and w[0] > 0 and learn.nonnegative_weights(x.limit(0), ["a", "b"], "y") == [0.0, 0.0]


def test_places_among_stored_values(spark):
    tr = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 10.0)] + [(None,)], "v double")
    te = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, 3.0), (4, 99.0), (5, None)], "k int, v double")
    got = {r["k"]: r["e"] for r in learn.stored_ecdf(tr, te, "v", "e").collect()}
    assert got == {1: 0.0, 2: 0.75, 3: 0.75, 4: 1.0, 5: None}


def test_composite_needs_context_and_rarity(spark):
    cols = "k int, strong double, period_end double, late double, manual double, round double, a double, b double"
    rows = [(1, 0.0, 0.1, 0.0, 0.5, 0.0, 0.96, 0.0), (2, 0.5, 0.1, 0.0, 0.5, 0.0, 0.96, 0.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.99, 0.99), (4, 0.0, 0.1, 0.5, 0.0, 0.0, 0.92, 0.0), (5, 0.0, 0.1, 0.5, 0.5, 0.5, 0.5, 0.5)]
    got = {r["k"]: r["composite"] for r in timeseries.composite(spark.createDataFrame(rows, cols), ["a", "b"]).collect()}
    assert got[1] == 0.8 and got[2] == 0.0 and got[3] == 0.0 and math.isclose(got[4], 0.92 * 0.7) and got[5] == 0.0


def test_log_and_append(spark):
    log = sinks.Log(spark, new_path(spark, "log"))
    rows = lambda *x: spark.createDataFrame(x, "id string, at int, v string")
    log.append(rows(("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")))
    log.append(rows(("a", 2, "x2")))
    log.append(rows(("b", 3, "gone")), deleted=True)
    assert [(r["id"], r["v"]) for r in log.current("id", ["at"]).collect()] == [("a", "x2")] and log.all().count() == 5 and log.all(id="a").count() == 2
    at = new_path(spark, "once")
    for _ in range(2):
        sinks.append_new(rows(("k", 2, "b"), ("k", 1, "a"), (None, 1, "n")), at, "id")
    assert [(r["id"], r["at"], r["v"]) for r in spark.read.parquet(at).collect()] == [("k", 1, "a")]


def test_mapping_tiers(spark):
    got = mapping.map_tiers(["Posting Date", "post_date", "belnr", "junk"], types={"belnr": "str", "Posting Date": "str", "post_date": "date"})
    assert ("posting_date", "post_date", "alias", 1.0) in got and all(n != "Posting Date" for _, n, _, _ in got)  # its values are no dates
    assert mapping.learned({"document_id": "Beleg"}, {"document_id": ("Beleg",)}) == {"document_id": ("Beleg",)}
    df = spark.createDataFrame([("plain",), ("감사".encode().decode("latin-1"),), ("감사",), ("café",), (None,), ("",)], "t string")
    assert [r["t"] for r in df.select(mapping.repaired(F.col("t")).alias("t")).collect()] == ["plain", "감사", "감사", "café", None, ""]


def test_absent_sidecars(spark, tmp_path):
    assert sidecars.load_all(spark, str(tmp_path)) == {}
    (tmp_path / "master_data").mkdir()
    (tmp_path / "master_data/vendors.json").write_text('[{"id": "v1"},\n {"id": "v2"}]')
    got = sidecars.load_all(spark, str(tmp_path), "L")
    assert list(got) == ["vendors"] and got["vendors"].filter("upload_batch_id = 'L'").count() == 2
