import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import digest, topn


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), s))
    out = set()
    for g in {k[0] for k in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))
        out |= {(g, i, k + 1) for k, (_, i) in enumerate(ranked[:n])}
    return out


def test_top_n_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "hot", "hot", "hot", *"abcdefgh"]), rnd.choice([None, *(f"c{k}" for k in range(40))]), rnd.choice([None, float("nan"), -1.0, *(k / 8 for k in range(8))])) for _ in range(4000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, i string, score double, rank_no string").repartition(5)
    for n in (1, 3, 7):
        got = {(r["g"], r["i"], r["rank_no"]) for r in topn.top_n_per_group(df, "g", "score", "i", n).collect()}
        assert got == brute(rows, n)
    assert topn.top_n_per_group(df.limit(0), "g", "score", "i", 3).count() == 0


def test_digest_merges_within_bound():
    rng = np.random.default_rng(3)
    x = rng.lognormal(3, 2, 200_000)
    parts = [digest.cluster(p, np.ones(len(p))) for p in np.array_split(x, 17)]
    m, w = digest.cluster(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert len(m) <= digest.COMPRESSION + 2 and w.sum() == len(x)
    x.sort()
    for p in (1, 25, 50, 90, 99):
        at = math.ceil(len(x) * p / 100)
        est = digest.value_at(m, w, x[0], x[-1], at)
        q = p / 100
        assert abs(np.searchsorted(x, est) - at) <= len(x) * 2 * math.pi * math.sqrt(q * (1 - q)) / digest.COMPRESSION


def test_exact_percentiles(spark):
    rnd = random.Random(2)
    data = {"a": [rnd.gauss(0, 100) for _ in range(3000)], "b": [float(rnd.randint(0, 3)) for _ in range(500)], "c": [7.0], "d": [1.0] * 900 + [1e12] * 100}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), (None, 5.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(r["g"], r["percentile"]): r for r in digest.exact_percentiles(df, "g", F.col("v"), (1, 50, 90, 99)).collect()}
    assert len(got) == 16
    for (g, p), r in got.items():
        vs = sorted(data[g])
        assert r["value"] == vs[math.ceil(len(vs) * p / 100) - 1] and r["n"] == len(vs)
        assert r["rank_error"] <= 0.05 * len(vs) + 1
    assert digest.exact_percentiles(df.limit(0), "g", F.col("v"), (50,)).count() == 0


def test_widening_reaches_any_value(spark, monkeypatch):
    """Digests that mislead are found out by the count."""
    df = spark.createDataFrame([("a", float(k)) for k in range(1000)], "g string, v double")
    bad = spark.createDataFrame([("a", [900.0, 950.0], [500.0, 500.0], 900.0, 999.0)], "g string, means array<double>, weights array<double>, low double, high double")
    r = digest.exact_percentiles(df, "g", F.col("v"), (50,), bad).collect()
    assert [(x["value"], x["n"]) for x in r] == [(499.0, 1000)]


def test_scores_of_other_types(spark):
    df = spark.sql("select 'g' g, concat('i', id) i, 9007199254740992 + id as s from range(4)")
    assert [r["i"] for r in topn.top_n_per_group(df, "g", "s", "i", 2).orderBy("rank_no").collect()] == ["i3", "i2"]
    df = df.withColumn("s", F.expr("cast(concat('0.1000000000000000', substring(i, 2)) as decimal(38,18))"))
    assert [r["i"] for r in topn.top_n_per_group(df, "g", "s", "i", 2).orderBy("rank_no").collect()] == ["i3", "i2"]


def test_a_group_whose_values_are_close(spark):
    """One group holds nearly all rows, most of them in a narrow range: exact values come out of ordered parts."""
    df = spark.range(40_000).selectExpr("if(id % 20 = 0, 'b', 'a') g", "1000000 + (id * 7919 % 40000) / 1e6 v")
    got = {(r["g"], int(r["percentile"])): r for r in digest.exact_percentiles(df, "g", F.col("v"), (1, 50, 99)).collect()}
    for g in "ab":
        v = sorted(r["v"] for r in df.filter(F.col("g") == g).collect())
        for p in (1, 50, 99):
            assert got[g, p]["value"] == v[-(-len(v) * p // 100) - 1] and got[g, p]["n"] == len(v)
