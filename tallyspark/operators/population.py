"""Signals of whole populations: one row per account, month, user or partner."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import base_amount, blank, plain, robust_z, zero
from . import features as X

#: The expected share of each leading digit, log10(1 + 1/d).
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def benford(gl: DataFrame, keys: list[str], least: int = 500, s: Settings = DEFAULT) -> DataFrame:
    """Per group: n, mean absolute deviation of the leading digits' shares from the expected ones, chi-square, the largest distance of the cumulative shares, and the digits that deviate by more than the threshold."""
    d = X.amount_features(gl, s).filter(F.col("first_digit").isNotNull())
    counts = [F.count(F.when(F.col("first_digit") == k, 1)).alias(f"c{k}") for k in range(1, 10)]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts).filter(F.col("n") >= least)
    share = lambda k: F.col(f"c{k}") / F.col("n")
    mad = sum((F.abs(share(k) - BENFORD[k - 1]) for k in range(1, 10)), F.lit(0.0)) / 9
    chi = sum((F.pow(F.col(f"c{k}") - F.col("n") * BENFORD[k - 1], 2) / (F.col("n") * BENFORD[k - 1]) for k in range(1, 10)), F.lit(0.0))
    cum, dist = F.lit(0.0), []
    for k in range(1, 10):
        cum = cum + share(k) - BENFORD[k - 1]
        dist.append(F.abs(cum))
    return g.select(*keys, "n", mad.alias("mad"), chi.alias("chi_square"), F.greatest(*dist).alias("ks"), (mad > s.benford_mad).alias("deviates"), F.array_compact(F.array(*(F.when(F.abs(share(k) - BENFORD[k - 1]) > s.benford_mad, F.lit(k)) for k in range(1, 10)))).alias("digits"))


def _binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k), by summing the terms from the mode of the tail on."""
    out = []
    for kk, nn, pp in zip(k, n, p, strict=True):
        if kk <= 0 or pp >= 1:
            out.append(1.0)
            continue
        if pp <= 0 or kk > nn:
            out.append(0.0)
            continue
        # the longer side is summed as its complement
        lo, hi, flip = (int(kk), int(nn), False) if kk > nn * pp else (0, int(kk) - 1, True)
        total = 0.0
        at = hi if flip else lo
        term = math.exp(math.lgamma(nn + 1) - math.lgamma(at + 1) - math.lgamma(nn - at + 1) + at * math.log(pp) + (nn - at) * math.log1p(-pp))
        while lo <= at <= hi and (term > 1e-18 * max(total, 1e-300)):
            total += term
            if flip:
                term *= at / (nn - at + 1) * (1 - pp) / pp
                at -= 1
            else:
                term *= (nn - at) / (at + 1) * pp / (1 - pp)
                at += 1
        out.append(min(1.0, max(0.0, 1 - total if flip else total)))
    return pd.Series(out, dtype="float64")


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """On aggregated rows only."""
    return F.pandas_udf(_binomial_tail, "double")(k.cast("long"), n.cast("long"), p.cast("double"))


def round_density(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(axis, key, n, rounds, share, excess, p_value) of accounts, months and creators with more round amounts than the ledger as a whole."""
    x = X.amount_features(gl, s).filter("base_amount > 0").select(
        F.col("is_round_number").cast("int").alias("r"), F.coalesce("gl_account", F.lit("")).alias("gl_account"), F.coalesce(F.date_format("posting_date", "yyyy-MM"), F.lit("")).alias("month"), F.coalesce(plain("created_by"), F.lit("")).alias("creator")
    )
    one = x.agg(F.avg("r")).first()[0] or 0.0
    out = None
    for axis in ("gl_account", "month", "creator"):
        g = x.filter(F.col(axis) != "").groupBy(F.col(axis).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("rounds"))
        g = g.select(F.lit(axis).alias("axis"), "key", "n", "rounds", (F.col("rounds") / F.col("n")).alias("share")).withColumn("excess", F.col("share") - F.lit(one))
        out = g if out is None else out.unionByName(g)
    out = out.filter((F.col("n") >= s.round_least) & (F.col("excess") >= s.round_excess))
    return out.withColumn("p_value", binomial_tail(F.col("rounds"), F.col("n"), F.lit(one))).filter("p_value <= 0.01")


def concentration(gl: DataFrame, unit: str = "month", s: Settings = DEFAULT, lanes: bool = False) -> DataFrame:
    """Buckets of an account and year (lanes: also of period ends and other days apart) with far more documents than its other buckets (robust z)."""
    p = F.col("posting_date")
    end = (F.datediff(F.last_day(p), p) <= s.period_margin) | (F.day(p) <= s.period_margin)
    x = gl.filter(~blank("gl_account") & p.isNotNull() & F.col("document_id").isNotNull()).withColumn("lane", F.when(end, "period_end").otherwise("regular"))
    key = ["gl_account", "year", "lane"] if lanes else ["gl_account", "year"]
    b = x.withColumn("year", F.year(p)).groupBy(*key, F.date_trunc(unit, "posting_date").cast("date").alias("bucket")).agg(F.count_distinct("document_id").alias("docs"))
    g = b.groupBy(*key).agg(F.count(F.lit(1)).alias("buckets"), F.expr("percentile(docs, array(0.25, 0.5, 0.75))").alias("q"))
    mad = b.join(g, key).withColumn("dev", F.abs(F.col("docs") - F.col("q")[1])).groupBy(*key).agg(F.expr("percentile(dev, 0.5)").alias("mad"))
    j = b.join(g, key).join(mad, key)
    z = robust_z(F.col("docs").cast("double"), F.col("q")[1], F.col("mad"), F.col("q")[2] - F.col("q")[0])
    return j.withColumn("z", z).filter((F.col("z") >= s.concentration_z) & (F.col("docs") >= s.concentration_docs) & (F.col("buckets") >= 3)).select(*key, "bucket", "docs", "z")


def monthly_shares(gl: DataFrame) -> DataFrame:
    """(fiscal_year, company_code, gl_account, fiscal_period, ratio): each period's part of the account's year, over aggregated rows."""
    key = ["fiscal_year", "company_code", "gl_account"]
    m = gl.filter(~blank("gl_account")).groupBy(*key, "fiscal_period").agg(F.sum(zero("debit_amount") + zero("credit_amount")).alias("a"))
    return m.select(*key, "fiscal_period", F.try_divide("a", F.sum("a").over(Window.partitionBy(*key))).alias("ratio"))


def partner_signals(gl: DataFrame, since, recent, s: Settings = DEFAULT) -> DataFrame:
    """(partner, signal, lines) of the period from `since` on: first seen in it; dormant before it (seen earlier, but not since `recent`, the gap at least dormant_days); or rare (as few
    lines as the lowest tenth of at least 50 partners)."""
    p = gl.filter(~blank("trading_partner") & F.col("posting_date").isNotNull()).select(F.trim("trading_partner").alias("partner"), F.col("posting_date").cast("date").alias("d"))
    now, before, late = F.col("d") >= F.lit(since), F.col("d") < F.lit(since), (F.col("d") < F.lit(since)) & (F.col("d") >= F.lit(recent))
    g = p.groupBy("partner").agg(
        F.count(F.when(now, 1)).alias("now"), F.count(F.when(before, 1)).alias("before"), F.count(F.when(late, 1)).alias("last"), F.min(F.when(now, F.col("d"))).alias("first_now"), F.max(F.when(before, F.col("d"))).alias("last_before"),
    ).filter("now > 0")
    q = g.agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile(now, {s.rare_quantile})").alias("q")).first()
    rare = (F.col("now") <= q["q"]) if q["n"] >= 50 else F.lit(False)
    dormant = (F.col("before") > 0) & (F.col("last") == 0) & (F.datediff("first_now", "last_before") >= s.dormant_days)
    tags = F.array_compact(F.array(F.when(F.col("before") == 0, F.lit("first_seen")), F.when(dormant, F.lit("dormant")), F.when(rare, F.lit("rare"))))
    return g.select("partner", F.explode(tags).alias("signal"), F.col("now").alias("lines"))


def partner_summary(gl: DataFrame) -> DataFrame:
    """Partners by amount: lines, documents, amount, rank (equal amounts by name)."""
    g = gl.filter(~blank("trading_partner")).groupBy(F.trim("trading_partner").alias("partner")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("document_id").alias("docs"), F.round(F.sum(base_amount()), 2).alias("amount"))
    return g


def activity_shift(current: DataFrame, prior: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Accounts whose total, count and average moved against the prior period: 0.5, 0.3 and 0.2 of the relative changes add up to more than the threshold, or that are new."""
    b = base_amount()
    side = lambda gl, p: gl.filter(~blank("gl_account")).groupBy("gl_account").agg(F.sum(b).alias(f"{p}total"), F.count(F.lit(1)).alias(f"{p}n"), F.avg(b).alias(f"{p}avg"))
    j = side(current, "").join(side(prior, "p_"), "gl_account", "left")
    rel = lambda c: F.abs(F.col(c) - F.col(f"p_{c}")) / F.greatest(F.abs(F.col(f"p_{c}")), F.lit(1.0))
    score = F.when(F.col("p_n").isNotNull(), 0.5 * rel("total") + 0.3 * rel("n") + 0.2 * rel("avg"))
    return j.withColumn("score", score).withColumn("is_new", F.col("p_n").isNull()).filter(F.col("is_new") | (F.col("score") > s.shift_activity)).select("gl_account", "n", "score", "is_new")


def shape_shift(current: DataFrame, prior: DataFrame, bucket: Column, least: int = 100, s: Settings = DEFAULT) -> DataFrame:
    """Accounts whose spread of documents over the buckets (months, say) differs from the prior period: Jensen-Shannon distance (base e, a square root) above the threshold and the top bucket's
    share moved by at least shift_top, given enough documents in both."""
    docs = lambda gl, a, b: gl.filter(~blank("gl_account") & F.col("posting_date").isNotNull()).groupBy("gl_account", bucket.alias("m")).agg(F.count_distinct("document_id").alias("c")).select("gl_account", "m", (F.col("c") * a).alias("a"), (F.col("c") * b).alias("b"))
    g = docs(current, 1, 0).unionByName(docs(prior, 0, 1)).groupBy("gl_account", "m").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = g.groupBy("gl_account").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).filter((F.col("na") >= max(1, least)) & (F.col("nb") >= max(1, least)))
    x = g.join(t, "gl_account").withColumns({"p": F.try_divide("a", "na"), "q": F.try_divide("b", "nb")})
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(2 * F.col(c) / (F.col("p") + F.col("q")))).otherwise(0.0)
    r = x.groupBy("gl_account", "na", "nb").agg((F.sum(kl("p") + kl("q")) / 2).alias("js"), F.abs(F.max("p") - F.max("q")).alias("top_shift"))
    return r.select("gl_account", "na", "nb", F.sqrt(F.greatest("js", F.lit(0.0))).alias("distance"), "top_shift").filter((F.col("distance") > s.shift_shape) & (F.col("top_shift") >= s.shift_top))


def trend(gl: DataFrame, unit: str = "quarter", share: float = 0.7, least: int = 3) -> DataFrame:
    """Accounts whose totals move in the same direction in most steps between periods."""
    t = gl.filter(~blank("gl_account") & F.col("posting_date").isNotNull()).groupBy("gl_account", F.date_trunc(unit, "posting_date").alias("t")).agg(F.sum(base_amount()).alias("v"))
    d = t.withColumn("step", F.signum(F.round(F.col("v") - F.lag("v").over(Window.partitionBy("gl_account").orderBy("t")), 2)))
    g = d.filter("step is not null").groupBy("gl_account").agg(F.count(F.lit(1)).alias("steps"), F.count(F.when(F.col("step") > 0, 1)).alias("up"), F.count(F.when(F.col("step") < 0, 1)).alias("down"))
    return g.withColumn("dominant", F.greatest("up", "down") / F.col("steps")).filter((F.col("steps") >= least) & (F.col("dominant") >= share))


def sign_bias(gl: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """Accounts whose monthly net amounts are nearly always of the same sign."""
    m = gl.filter(~blank("gl_account") & F.col("posting_date").isNotNull()).groupBy("gl_account", F.date_trunc("month", "posting_date").alias("t")).agg(F.round(F.sum(zero("debit_amount") - zero("credit_amount")), 2).alias("net")).filter("net <> 0")
    g = m.groupBy("gl_account").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("net") > 0, 1)).alias("up"))
    return g.withColumn("same_sign", F.greatest(F.col("up"), F.col("n") - F.col("up")) / F.col("n")).filter((F.col("n") >= least) & (F.col("same_sign") >= share))


def spans(gl: DataFrame) -> DataFrame:
    """Every line once per unit it is compared in: (unit 'year', the fiscal year) and (unit 'half', the year and 1 or 2 of the posting date), with the bucket of its month. Lines without a period are left out of that unit."""
    y, m = F.year("posting_date"), F.month("posting_date")
    year = F.struct(F.lit("year").alias("unit"), F.col("fiscal_year").cast("int").alias("period"), m.alias("bucket"))
    half = F.struct(F.lit("half").alias("unit"), (y * 10 + F.when(m > 6, 2).otherwise(1)).cast("int").alias("period"), ((m - 1) % 6).alias("bucket"))
    return gl.withColumn("_u", F.explode(F.array(year, half))).select("*", "_u.*").drop("_u").filter("period is not null")


def priors(x: DataFrame) -> DataFrame:
    """(unit, period, prior): each period that occurs with the one before it that occurs; the first of a unit has none and is left out."""
    w = Window.partitionBy("unit").orderBy("period")  # over periods
    return F.broadcast(x.select("unit", "period").distinct().withColumn("prior", F.lag("period").over(w)).filter("prior is not null"))


def activity_shifts(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """activity_shift of every period of the ledger against the one before it: (unit, period, gl_account, n, score, is_new)."""
    x, b = spans(gl), base_amount()
    g = x.filter(~blank("gl_account")).groupBy("unit", "period", "gl_account").agg(F.sum(b).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(b).alias("avg"))
    p = g.select("unit", F.col("period").alias("prior"), "gl_account", *(F.col(c).alias(f"p_{c}") for c in ("total", "n", "avg")))
    j = g.join(priors(x), ["unit", "period"]).join(p, ["unit", "prior", "gl_account"], "left")
    rel = lambda c: F.abs(F.col(c) - F.col(f"p_{c}")) / F.greatest(F.abs(F.col(f"p_{c}")), F.lit(1.0))
    j = j.withColumn("score", 0.5 * rel("total") + 0.3 * rel("n") + 0.2 * rel("avg")).withColumn("is_new", F.col("p_n").isNull())
    return j.filter(F.col("is_new") | (F.col("score") > s.shift_activity)).select("unit", "period", "gl_account", "n", "score", "is_new")


def shape_shifts(gl: DataFrame, least: dict[str, int], s: Settings = DEFAULT) -> DataFrame:
    """shape_shift of every period against the one before it, over the months of years and of halves, given `least` documents of the unit in both."""
    x = spans(gl)
    c = x.filter(~blank("gl_account") & F.col("posting_date").isNotNull()).groupBy("unit", "period", "gl_account", "bucket").agg(F.count_distinct("document_id").alias("c"))
    pr = priors(x)
    now = c.join(pr, ["unit", "period"]).select("unit", "period", "gl_account", "bucket", F.col("c").alias("a"), F.lit(0).cast("bigint").alias("b"))
    before = c.withColumnRenamed("period", "prior").join(pr, ["unit", "prior"]).select("unit", "period", "gl_account", "bucket", F.lit(0).cast("bigint").alias("a"), F.col("c").alias("b"))
    key = ["unit", "period", "gl_account"]
    g = now.unionByName(before).groupBy(*key, "bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    enough = F.coalesce(*(F.when(F.col("unit") == u, F.lit(max(1, n))) for u, n in least.items()))
    t = g.groupBy(*key).agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).filter((F.col("na") >= enough) & (F.col("nb") >= enough))
    y = g.join(t, key).withColumns({"p": F.col("a") / F.col("na"), "q": F.col("b") / F.col("nb")})
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(2 * F.col(c) / (F.col("p") + F.col("q")))).otherwise(0.0)
    r = y.groupBy(*key, "na", "nb").agg((F.sum(kl("p") + kl("q")) / 2).alias("js"), F.abs(F.max("p") - F.max("q")).alias("top_shift"))
    return r.select(*key, "na", "nb", F.sqrt(F.greatest("js", F.lit(0.0))).alias("distance"), "top_shift").filter((F.col("distance") > s.shift_shape) & (F.col("top_shift") >= s.shift_top))


def drifts_numeric(gl: DataFrame, column: str, eps: float = 1e-4) -> DataFrame:
    """learn.psi_numeric of every period against the one before it: (unit, period, psi)."""
    x = spans(gl)
    pr = priors(x)
    v = x.filter(F.col(column).isNotNull()).groupBy("unit", "period").agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    by = pr.join(v.withColumnRenamed("period", "prior"), ["unit", "prior"]).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    by = F.broadcast(by.select("unit", "period", F.explode(F.array(F.struct(F.col("period").alias("of"), F.lit(1).alias("now")), F.struct(F.col("prior").alias("of"), F.lit(0).alias("now")))).alias("k"), "m", "s").select("unit", "period", F.col("k.of").alias("of"), F.col("k.now").alias("now"), "m", "s"))
    y = x.filter(F.col(column).isNotNull()).select("unit", F.col("period").alias("of"), F.col(column).alias("v")).join(by, ["unit", "of"])
    b = F.greatest(F.lit(0), F.least(F.lit(9), F.floor((F.col("v") - F.col("m")) / F.col("s") * 2 + 5)))
    return _psi_by(y.groupBy("unit", "period", b.cast("int").alias("bin")).agg(F.sum(1 - F.col("now")).alias("a"), F.sum("now").alias("b")), eps)


def drifts_categorical(gl: DataFrame, column: str, k: int = 10, eps: float = 1e-4) -> DataFrame:
    """learn.psi_categorical of every period against the one before it: (unit, period, psi)."""
    x = spans(gl)
    pr = priors(x)
    c = x.groupBy("unit", "period", F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    top = c.filter("v is not null").withColumn("_r", F.row_number().over(Window.partitionBy("unit", "period").orderBy(F.desc("c"), "v"))).filter(F.col("_r") <= k)  # over distinct values
    top = top.withColumnRenamed("period", "prior").join(pr, ["unit", "prior"]).select("unit", "period", "v", F.lit(True).alias("listed"))
    now = c.join(pr, ["unit", "period"]).select("unit", "period", "v", F.lit(0).cast("bigint").alias("a"), F.col("c").alias("b"))
    before = c.withColumnRenamed("period", "prior").join(pr, ["unit", "prior"]).select("unit", "period", "v", F.col("c").alias("a"), F.lit(0).cast("bigint").alias("b"))
    y = now.unionByName(before).join(top, ["unit", "period", "v"], "left")
    bins = F.when(F.col("listed"), F.col("v").cast("string")).otherwise("_OTHER_")
    return _psi_by(y.groupBy("unit", "period", bins.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")), eps)


def _psi_by(j: DataFrame, eps: float) -> DataFrame:
    w = Window.partitionBy("unit", "period")  # over bins
    pa, pb = (F.greatest(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(eps)) for c in "ab")
    return j.select("unit", "period", ((pb - pa) * F.log(pb / pa)).alias("t")).groupBy("unit", "period").agg(F.sum("t").alias("psi"))
