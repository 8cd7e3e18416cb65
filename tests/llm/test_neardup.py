import random

from pyspark.sql import functions as F

from tallyspark.llm import neardup as N

DAY = 19_000


def shingles(t, k=3):
    t = " ".join(t.lower().split())
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def brute(rows, a):
    out = set()
    ok = [r for r in rows if r[1] is not None and r[2] is not None and r[3] is not None and r[3] > 0 and shingles(r[4] or "")]
    for x in ok:
        for y in ok:
            if x[0] < y[0] and x[1] == y[1] and abs(x[2] - y[2]) <= a.days and abs(x[3] - y[3]) <= a.amount * max(x[3], y[3]):
                s, t = shingles(x[4]), shingles(y[4])
                if len(s & t) >= a.similarity * len(s | t):
                    out.add((x[0], y[0]))
    return out


def made(n, seed):
    rnd = random.Random(seed)
    words = ["payment", "run", "lease", "판매 장려금", "audit fee", "retail", "desk", "plant", "south", "정산"]
    rows = []
    for k in range(n):
        if rows and rnd.random() < 0.4:
            _, g, d, m, t = rnd.choice(rows)
            t = (t or "x").replace("a", rnd.choice(["a", "A", "  a", "e"]), 1) + rnd.choice(["", " ", "7", "!"])
            rows.append((f"d{k:05}", g, d + rnd.randint(-8, 8), m * rnd.choice([1, 0.98, 0.981, 1.019, 1.02, 1.03]), t))
        else:
            rows.append((f"d{k:05}", rnd.choice("AB"), DAY + rnd.randint(0, 60), rnd.choice([100.0, 101.0, 5000.0, 123456.0]), " ".join(rnd.choices(words, k=4))))
    return [*rows, ("n1", None, DAY, 1.0, "abc def"), ("n2", "A", None, 1.0, "abc def"), ("n3", "A", DAY, None, "abc def"), ("n4", "A", DAY, -5.0, "abc def"), ("n5", "A", DAY, 1.0, None), ("n6", "A", DAY, 1.0, "ab"), ("n7", "A", DAY, 1.0, " AB ")]


SCHEMA = "id string, grp string, day int, amount double, text string"


def test_all_pairs(spark):
    rows = made(300, 1)
    got = {tuple(r) for r in N.alike_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute(rows, N.Alike())


def test_recall_where_tries_are_deep(spark):
    """With cells counted as crowded from 5 records on, tries are matched down to several labels; nothing false, and at least the target recall."""
    rows = made(400, 2)
    for a in (N.Alike(full=5, widen=1000), N.Alike(full=5, widen=4)):
        got = {tuple(r) for r in N.alike_pairs(spark.createDataFrame(rows, SCHEMA), a).collect()}
        want = brute(rows, a)
        assert got <= want and len(got) >= 0.995 * len(want)


def test_trees_reach_the_target():
    a = N.Alike()
    for depth in (1, 2, 3):
        assert 1 - (1 - a.similarity**depth) ** a.trees(depth) >= a.recall
    assert [a.depth(n) for n in (1, a.full, a.full + 1, a.full * a.widen, a.full * a.widen + 1)] == [1, 1, 2, 2, 3]


def test_a_crowded_cell(spark):
    """1,200 records in one cell, at default parameters and with several labels."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choices(words, k=9)) for _ in range(600)]
    rows = [(f"d{k:05}", "A", DAY, 100.0, t) for k, t in enumerate(base)]
    rows += [(f"e{k:05}", "A", DAY, 100.0, t.replace("w1", "v1", 1) + " x" * (k % 3)) for k, t in enumerate(base)]
    want = brute(rows, N.Alike())
    for a in (N.Alike(), N.Alike(full=50, widen=4)):
        got = {tuple(r) for r in N.alike_pairs(spark.createDataFrame(rows, SCHEMA), a).collect()}
        assert got <= want and len(got) >= 0.999 * len(want) and len(want) >= 600
    r = N.recall(spark.createDataFrame(rows, SCHEMA), F.col("id").endswith("0")).first()
    assert r["links"] > 50 and r["found"] >= 0.99 * r["links"]


def test_equal_records_and_repeated_ids(spark):
    rows = [(f"k{k:03}", "G", DAY, 10.0, "one and the same text") for k in range(60)] + [("k000", "G", DAY, 10.0, "one and the same texts"), ("k001", None, DAY, 10.0, "x"), ("q", None, None, None, None), (None, "G", DAY, 10.0, "one and the same text")]
    got = N.alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 60 * 59 // 2 and all(r["id_a"] < r["id_b"] for r in got)


def test_links_and_empty(spark):
    rows = [("a", "G", DAY, 10.0, "same text"), ("b", "G", DAY, 10.0, "same text"), ("c", "G", DAY + 1, 10.0, "same texts"), ("z", "G", DAY, 99.0, "other")]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in N.links_per_record(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 1), "z": ("z", 0)}
    assert N.alike_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
