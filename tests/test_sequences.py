"""Windows of lines over whole histories, against brute force."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.operators import learn
from tallyspark.plans import analytics


def windows(lines, length, stride=1):
    """{(user, key): (at, valid, steps)} of (user, order, key, step)."""
    of, out = defaultdict(list), {}
    for user, order, key, step in lines:
        of[user].append((order is None, order, key, step))
    for user, x in of.items():
        x.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        for at in range(length, len(x) + 1, stride) if len(x) >= length else [len(x)]:
            steps = [r[3] for r in x[max(0, at - length) : at]]
            out[user, x[at - 1][2]] = (at, len(steps), [[0.0] * len(steps[0])] * (length - len(steps)) + steps)
    return out


def test_user_sequences_cover_whole_histories(spark, small):
    gl = spark.read.parquet(f"{small}/general_ledger.parquet").filter("created_by is not null").collect()
    base = lambda r: max(r["debit_amount"] or 0.0, r["credit_amount"] or 0.0)
    want = windows([(r["created_by"], r["posting_date"].timestamp(), r["row_id"], [math.log1p(base(r)), float(r["fiscal_period"] or 0)]) for r in gl], 16)
    got = analytics.sequences_of_users(spark, small).collect()
    assert len(got) == len(want) and {r["created_by"] for r in got} == {r["created_by"] for r in gl}
    for r in got:
        at, valid, steps = want[r["created_by"], r["row_id"]]
        assert (r["at"], r["valid"]) == (at, valid)
        assert all(math.isclose(a, b, abs_tol=1e-9) for s, t in zip(r["steps"], steps, strict=True) for a, b in zip(s, t, strict=True))


def test_sequences_of_odd_users(spark):
    """Blocks and bins smaller than a window, undated lines, users of one line, users of just a window's length, no user."""
    lines = [("many", k // 3, k, [float(k)]) for k in range(40)] + [("many", None, 100 + k, [1.0]) for k in range(3)] + [("one", 5, 200, [2.0])] + [("four", k, 300 + k, [3.0]) for k in range(4)]
    df = spark.createDataFrame([(u, o, k, s[0]) for u, o, k, s in lines] + [(None, 1, 999, 9.0)], "user string, o int, row_id bigint, v double")
    for length, stride, block in ((4, 1, 4), (4, 1, 7), (4, 3, 5), (1, 1, 1)):
        got = learn.sequences(df, "user", F.coalesce("o", F.lit(1000)), ["o", "row_id"], ["v"], length=length, stride=stride, block=block).collect()
        assert {(r["user"], r["row_id"]): (r["at"], r["valid"], [list(s) for s in r["steps"]]) for r in got} == windows(lines, length, stride)
        assert len(got) == len(windows(lines, length, stride))
