"""Small hand-made ledgers: nulls, blanks, ties, repeated rows, order of rows and number of partitions."""

import datetime as dt

import pytest

from tallyspark.operators import features, population, rules, scoring, timeseries, validate

COLS = {
    "row_id": "long", "document_id": "string", "company_code": "string", "fiscal_year": "int", "fiscal_period": "int", "posting_date": "timestamp_ntz", "document_date": "timestamp_ntz", "document_type": "string", "gl_account": "string", "debit_amount": "double",
    "credit_amount": "double", "local_amount": "double", "reference": "string", "header_text": "string", "created_by": "string", "user_persona": "string", "source": "string", "business_process": "string", "approved_by": "string", "line_text": "string", "trading_partner": "string",
    "upload_batch_id": "string",
}
BASE = dict(document_id="J1", company_code="C1", fiscal_year=2024, fiscal_period=3, posting_date=dt.datetime(2024, 3, 12, 10), document_date=dt.datetime(2024, 3, 12), document_type="SA", gl_account="100000", debit_amount=0.0, credit_amount=0.0, created_by="U1", source="Manual", business_process="R2R", approved_by="U2")


@pytest.fixture
def ledger(spark):
    def make(*lines, parts=1):
        rows = [tuple((BASE | {"row_id": k + 1} | x).get(c) for c in COLS) for k, x in enumerate(lines)]
        return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in COLS.items())).repartition(parts)

    return make


@pytest.fixture
def employees(spark):
    return features.masters(spark.createDataFrame([("u2", 100.0, True), ("U3", 1e9, False), (None, 5.0, True)], "user_id string, approval_limit double, can_approve_je boolean"))


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


def test_unbalanced(ledger, employees):
    unbalanced = lambda gl: rules.document_tests(gl, employees).filter("rule_id = 'L1-01'")
    lines = [dict(debit_amount=5.0), dict(credit_amount=5.0), dict(document_id="J2", debit_amount=5.0), dict(document_id="J2", credit_amount=4.0), dict(document_id=None, debit_amount=1.0), dict(document_id=None, debit_amount=None), dict(document_id="J3", debit_amount=0.01)]
    for parts in (1, 7):
        assert ids(unbalanced(ledger(*lines, parts=parts))) == [3, 4, 5]
    assert ids(unbalanced(ledger())) == []


def test_missing_required(ledger):
    got = rules.row_tests(ledger({}, dict(gl_account=" "), dict(posting_date=None), dict(document_type=None))).filter("rule_id = 'L1-02'")
    assert ids(got) == [2, 3, 4]


def test_duplicate_payments(ledger):
    pay = dict(document_type="KZ", business_process="P2P", trading_partner="V1", reference="INV-1", debit_amount=1000.0)
    day = lambda n: dict(posting_date=dt.datetime(2024, 1, 1) + dt.timedelta(days=n))
    lines = [
        pay | dict(document_id="A") | day(0), pay | dict(document_id="B", debit_amount=1020.0) | day(300), pay | dict(document_id="C", reference="inv 1", debit_amount=1500.0) | day(1),
        pay | dict(document_id="D", reference=None, trading_partner="V2") | day(0), pay | dict(document_id="E", reference=" ", trading_partner="V2", debit_amount=1019.0) | day(90), pay | dict(document_id="F", reference=None, trading_partner="V2", debit_amount=1000.0) | day(181),
        pay | dict(document_id="G", trading_partner=None) | day(2), pay | dict(document_id="A") | day(0), pay | dict(document_id="H", trading_partner="V3", debit_amount=10.0) | day(0), pay | dict(document_id="I", trading_partner="V3", debit_amount=11.0) | day(1),
    ]
    # the repeated line of A doubles its amount to 2000, so B has no partner left; without it B is the later one
    assert ids(rules.duplicate_payments(ledger(*lines[:7], *lines[8:]))) == [2, 5, 9]
    assert ids(rules.duplicate_payments(ledger(*lines))) == [5, 10]


def test_reversals(ledger):
    lines = [dict(document_id="A", debit_amount=7.0), dict(document_id="B", credit_amount=7.0, posting_date=dt.datetime(2024, 4, 26)), dict(document_id="C", credit_amount=7.0, posting_date=dt.datetime(2024, 4, 27)), dict(document_id="D", debit_amount=7.0, gl_account="2"), dict(document_id="E", debit_amount=3.0), dict(document_id="E", credit_amount=3.0)]
    assert ids(rules.reversals(ledger(*lines))) == [1, 2]


def test_rare_pairs_and_gaps(ledger):
    d = lambda doc, a, **x: dict(document_id=doc, gl_account=a, **x)
    lines = [d("JE-1", "1", debit_amount=1.0), d("JE-1", "2", credit_amount=1.0), d("JE-2", "1", debit_amount=1.0), d("JE-2", "2", credit_amount=1.0), d("JE-9", "1", debit_amount=1.0), d("JE-9", "3", credit_amount=1.0)]
    assert ids(rules.rare_pairs(ledger(*lines))) == [5, 6]
    assert [(r["document_id"], r["gap"]) for r in rules.number_gaps(ledger(*lines)).collect()] == [("JE-9", 7)]
    far = [d("JE-99999", "1"), d("JE-100000", "1"), d("JE-250001", "1")]
    assert [(r["document_id"], r["gap"]) for r in rules.number_gaps(ledger(*far)).collect()] == [("JE-250001", 150001)]


def test_segregation(ledger, employees):
    lines = [dict(created_by="u1 ", business_process="P2P"), dict(created_by="U1", business_process="TRE"), dict(created_by="U1", business_process="O2C"), dict(created_by="U3", business_process="P2P"), dict(created_by="SVC_1", business_process="P2P"), dict(created_by="SVC_1", business_process="TRE"), dict(created_by=None, business_process="P2P")]
    lines = [x | dict(source="Manual") for x in lines]
    assert ids(rules.lookup_tests(ledger(*lines), employees).filter("rule_id = 'L1-06'")) == [1, 2, 3]


def test_limits_and_lookups(ledger, employees, spark):
    lines = [dict(document_id="A", debit_amount=95.0), dict(document_id="B", debit_amount=101.0), dict(document_id="C", debit_amount=5.0, approved_by="u3"), dict(document_id="D", debit_amount=5.0, approved_by=" "), dict(document_id="E", debit_amount=5.0, approved_by="X"), dict(document_id=None, debit_amount=500.0), dict(document_id="F", debit_amount=89.0, gl_account=" 7 ")]
    got = rules.document_tests(ledger(*lines), employees)
    assert ids(got.filter("rule_id = 'L2-01'")) == [1] and ids(got.filter("rule_id = 'L1-04'")) == [2, 3]
    got = rules.lookup_tests(ledger(*lines), employees, spark.createDataFrame([("100000",), ("8",), ("8",)], "account string"))
    assert ids(got.filter("rule_id = 'L1-07-02'")) == [5] and ids(got.filter("rule_id = 'L1-03'")) == [7]


def test_time_features(ledger):
    at = lambda *x: dict(posting_date=dt.datetime(*x))
    got = {r["row_id"]: r for r in features.time_features(ledger(at(2024, 3, 9, 23), at(2024, 3, 12, 6), at(2024, 12, 27, 20), dict(posting_date=None), at(2024, 3, 1, 9))).collect()}
    assert [got[k]["time_zone_category"] for k in range(1, 6)] == ["midnight", "overtime", "normal", "unknown", "overtime"]
    assert [got[k]["is_after_hours"] for k in range(1, 6)] == [True, False, False, False, False]
    assert [got[k]["is_weekend"] for k in range(1, 6)] == [True, False, False, False, False] and got[5]["is_holiday"] and got[4]["days_backdated"] is None
    assert not any(r["is_after_hours"] for r in features.time_features(ledger(at(2024, 3, 9), at(2024, 3, 10))).collect())


def test_zscore_ladder(ledger, spark):
    from pyspark.sql import functions as F

    lines = [dict(gl_account="400000", debit_amount=float(k % 5)) for k in range(40)] + [dict(gl_account="410000", debit_amount=100.0), dict(gl_account="900000", debit_amount=3.0), dict(gl_account=None, debit_amount=3.0)]
    got = {r["row_id"]: r["z"] for r in features.zscores(ledger(*lines), F.col("debit_amount"), "z").collect()}
    import statistics as st

    own = [float(k % 5) for k in range(40)]
    assert got[1] == pytest.approx((0 - 2) / st.stdev(own)) and got[41] == pytest.approx((100 - st.mean([*own, 100.0])) / st.stdev([*own, 100.0])) and got[42] == pytest.approx((3 - st.mean([*own, 100.0, 3, 3])) / st.stdev([*own, 100.0, 3, 3]))
    assert all(r["z"] is None for r in features.zscores(ledger(*lines[:5]), F.col("debit_amount"), "z").collect())


def test_text_quality(ledger):
    texts = [None, "  ", "ㅋㅋㅋ", "!!!", "aaaa", "Reversal of rent", "settlement", "정상 적요"]
    got = [r for r in features.text_features(ledger(*(dict(line_text=t) for t in texts))).orderBy("row_id").collect()]
    assert [r["description_quality"] for r in got] == ["missing", "missing", "corrupted", "corrupted", "corrupted", "normal", "normal", "normal"]
    assert got[5]["risk_keyword"] == "high" and got[6]["risk_keyword"] == "medium" and got[0]["char_entropy"] is None and got[1]["char_entropy"] == 0.0


def test_binomial_tail():
    import pandas as pd

    f = population._binomial_tail
    got = f(pd.Series([0, 3, 10, 11, 60]), pd.Series([10, 10, 10, 10, 100]), pd.Series([0.5, 0.5, 0.5, 0.5, 0.5]))
    assert got[0] == 1 and got[1] == pytest.approx(1 - (1 + 10 + 45) / 1024) and got[2] == pytest.approx(1 / 1024) and got[3] == 0 and got[4] == pytest.approx(0.02844396682)


def test_scores_and_combinations(spark):
    f = spark.createDataFrame([(1, "L1-01", 1.0), (1, "L2-03", 1.0), (1, "L3-04", 1.0), (2, "L1-05", 1.0), (3, "L3-05", 1.0)], "row_id long, rule_id string, score double")
    got = {r["row_id"]: r for r in scoring.row_scores(f).collect()}
    assert got[1]["risk_level"] == "High" and got[1]["anomaly_score"] == pytest.approx(0.25 * 0.45 + 0.2 * 0.45)
    assert got[2]["risk_level"] == "Low" and got[2]["anomaly_score"] == pytest.approx(0.24) and got[3]["risk_level"] == "Normal"
    u = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["y", "z"])], "unit string, fired array<string>")
    pick = lambda *x, **k: sorted(r["unit"] for r in scoring.combine(u, *x, **k).collect())
    assert pick(["x", "z"], ["y"]) == ["a", "c"] and pick([], ["y"]) == ["a", "c"] and pick([], []) == [] and pick(["x", "z"], [], strict=True) == []


def test_spine_and_empty_series(ledger, spark):
    c = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2), ("a", dt.date(2024, 1, 4), 1), ("b", dt.date(2024, 1, 2), 5)], "k string, day date, n long")
    assert sorted((r["k"], r["day"].day, r["n"]) for r in timeseries.spine(c, ["k"], "day", "n").collect()) == [("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("b", 2, 5)]
    e = ledger()
    assert timeseries.burst(e, ["company_code"]).count() == 0 and timeseries.pair_rarity(e, "gl_account", "source").count() == 0 and validate.missing_business_days(e).count() == 0
    assert validate.repeated_rows(e, ["row_id"]).first()["rows"] == 0
    assert validate.repeated_rows(ledger({}, {}, dict(source=None)), ["row_id"]).first()["repeated"] == 1


def test_fitted_detectors(spark):
    import random

    from tallyspark.operators import detect

    rnd = random.Random(1)
    rows = []
    for k in range(600):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((k, a, a + b * 0.1 if k else a + 9.0, b, float(a + b > 0)))
    x = spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double")
    worst = detect.reconstruction_errors(x, ["a", "b", "c"], 2).orderBy("error", ascending=False).first()
    assert worst["row_id"] == 0
    model = detect.supervised(x.filter("row_id < 400"), ["a", "c"], "label")
    held = detect.scored(model, x.filter("row_id >= 400"), ["label"]).collect()
    assert sum((r["score"] > 0.5) == (r["label"] > 0.5) for r in held) >= 0.95 * len(held)


def test_vectors(spark):
    from tallyspark.operators import similarity

    df = spark.createDataFrame([(k, [1.0, k / 1000], "g") for k in range(20)] + [(99, [-1.0, 0.0], "g"), (100, None, "g"), (101, [1.0, 1.0], None)], "i int, v array<float>, g string")
    assert [r["i"] for r in similarity.far_from_centre(df, "i", "v", "g", 0.95).collect()] == [99]


def test_ranks_and_shares(spark):
    import random

    from tallyspark.functions import ecdf

    rnd = random.Random(3)
    vals = [rnd.choice([None, 0.0, -3.0, 0.001, 0.0011, 5.0, 1e12, rnd.random()]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double").repartition(5)
    pos = sorted(v for v in vals if v and v > 0)
    for r in ecdf(df, "v", "e").collect():
        assert r["e"] == (sum(x <= r["v"] for x in pos) / len(pos) if r["v"] and r["v"] > 0 else 0.0)
    ranks = {r["i"]: r["k"] for r in scoring.rank_of(df, "i", "v", "k").collect()}
    some = [v for v in vals if v is not None]
    assert all(ranks[i] == (None if v is None else 1 + sum(x > v for x in some)) for i, v in enumerate(vals))
    assert ecdf(df.limit(0), "v", "e").count() == 0


def test_sides_too_large_to_send(spark):
    from tallyspark.session import small_or_shuffled

    big, small = spark.range(50), spark.range(5)
    plan = lambda side: big.join(side, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small_or_shuffled(small, 5)).lower() and "broadcast" not in plan(small_or_shuffled(small, 4)).lower()
