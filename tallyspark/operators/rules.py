"""Tests of ledger lines. Each takes a ledger and gives flags in long form, (row_id, rule_id, score): one row per line and test that holds.

Tests that compare lines aggregate first (per document, key or user) and join the few keys that hold back to the lines, so that neither a hot
key nor a pair of lines is ever spread out. A ledger without rows gives no flags; null keys never match one another."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import base_amount, blank, plain, zero
from ..session import at_once, small_or_shuffled, written
from . import features as X

REQUIRED = ("document_id", "company_code", "fiscal_year", "fiscal_period", "posting_date", "document_date", "document_type", "gl_account")


def flags(df: DataFrame, rule: str, score: Column | float = 1.0) -> DataFrame:
    return df.select("row_id", F.lit(rule).alias("rule_id"), (score if isinstance(score, Column) else F.lit(float(score))).cast("double").alias("score"))


def chart_of_accounts(gl: DataFrame, least: int = 10) -> DataFrame:
    """Where no chart is given: well-formed accounts that at least `least` lines use."""
    return gl.filter(F.col("gl_account").rlike(r"^[0-9]{6}\z")).groupBy(F.col("gl_account").alias("account")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("account")


def human(s: Settings = DEFAULT) -> Column:
    return ~F.coalesce(plain("user_persona") == "automated_system", F.lit(False)) & ~F.coalesce(plain("source").isin(*s.automated_sources), F.lit(False)) & ~F.coalesce(F.upper("created_by").contains("SVC_"), F.lit(False)) & ~blank("created_by")


#: Pairs of processes that one person should not work in.
SEPARATE = (("P2P", "TRE"), ("O2C", "TRE"), ("P2P", "R2R"))


def held(df: DataFrame, tests: dict[str, Column], scores: dict[str, float] | None = None) -> DataFrame:
    """The flags of several tests that are columns of one frame, in one pass."""
    each = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("rule_id"), F.lit((scores or {}).get(k, 1.0)).alias("score"))) for k, cond in tests.items()]
    return df.select("row_id", F.explode(F.array_compact(F.array(*each))).alias("x")).select("row_id", "x.rule_id", "x.score")


def document_tests(gl: DataFrame, people: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Tests of a line against its document's totals, from one aggregation and one join: unbalanced (L1-01: all lines of the document; a line without a document is its own), over or just below the
    approver's limit (L1-04, L2-01; people: features.masters()), and asset debits met by expense credits (L2-04: those lines, where the subtotals are within the tolerance)."""
    d, c = zero("debit_amount"), zero("credit_amount")
    asset, expense = X.starts(F.col("gl_account"), s.asset_prefixes), X.starts(F.col("gl_account"), s.expense_prefixes)
    x = gl.select("row_id", "document_id", F.coalesce(F.col("document_id"), F.concat(F.lit("#"), F.col("row_id").cast("string"))).alias("doc"), d.alias("d"), c.alias("c"), asset.alias("asset"), expense.alias("expense"), plain("approved_by").alias("approver"))
    docs = x.groupBy("doc").agg(F.sum(F.col("d") - F.col("c")).alias("off"), F.sum("d").alias("total"), F.sum(F.when(F.col("asset"), F.col("d")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("expense"), F.col("c")).otherwise(0.0)).alias("e"))
    x = x.join(docs, "doc").join(people, "approver", "left")
    limit = F.col("limit")
    total = F.when(F.col("document_id").isNotNull(), F.col("total"))
    met = F.col("document_id").isNotNull() & (F.col("a") > 0) & (F.col("e") > 0) & (F.abs(F.col("a") - F.col("e")) <= s.duplicate_tolerance * F.greatest("a", "e"))
    return held(x, {
        "L1-01": F.abs("off") > s.balance_tolerance, "L1-04": total > limit, "L2-01": (total >= limit * s.near_ratio) & (total < limit),
        "L2-04": met & ((F.col("asset") & (F.col("d") > 0)) | (F.col("expense") & (F.col("c") > 0))),
    })


def users(x: DataFrame, s: Settings = DEFAULT, pairs: tuple[tuple[str, str], ...] = SEPARATE) -> DataFrame:
    """(user, hit, late_hot) of people, from lines with is_after_hours: the processes of forbidden pairs they work in, and whether their share of after-hours lines is far above that of others (mean + sigma times the
    deviation over at least 3 people of 10 lines or more, and at least hours_ratio)."""
    u = x.filter(human(s)).groupBy(plain("created_by").alias("user")).agg(F.collect_set("business_process").alias("did"), F.avg(F.col("is_after_hours").cast("double")).alias("ratio"), F.count(F.lit(1)).alias("n"))
    u = written(u, "users")  # a set of processes per user is bounded by the number of processes
    one = u.filter("n >= 10").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("m"), F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)).alias("s")).first()
    hot = (F.col("n") >= 10) & (F.col("ratio") > one["m"] + s.hours_sigma * one["s"]) & (F.col("ratio") >= s.hours_ratio) if one["n"] >= 3 else F.lit(False)
    none = F.array().cast("array<string>")
    hit = F.array_distinct(F.flatten(F.array(*(F.when(F.array_contains("did", a) & F.array_contains("did", b), F.array(F.lit(a), F.lit(b))).otherwise(none) for a, b in pairs))))
    return u.select("user", hit.alias("hit"), hot.alias("late_hot")).filter((F.size("hit") > 0) | F.col("late_hot"))


def thresholds(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per company and year: the larger of 3.75 % of its result and 0.375 % of its revenue."""
    signed = lambda prefixes, plus, minus: F.sum(F.when(X.starts(F.col("gl_account"), prefixes), zero(plus) - zero(minus)).otherwise(0.0))
    per = gl.groupBy("company_code", "fiscal_year").agg(signed(s.revenue_prefixes, "credit_amount", "debit_amount").alias("rev"), signed(s.expense_prefixes, "debit_amount", "credit_amount").alias("exp"))
    return per.select("company_code", "fiscal_year", F.greatest(F.abs(F.col("rev") - F.col("exp")) * 0.05 * 0.75, F.abs("rev") * 0.005 * 0.75).alias("pm")).filter("pm > 0")


def lookup_tests(gl: DataFrame, people: DataFrame, chart: DataFrame | None = None, s: Settings = DEFAULT, pairs: tuple[tuple[str, str], ...] = SEPARATE, timed: bool | None = None) -> DataFrame:
    """Tests of a line against small tables, in one pass over the ledger: account not in the chart (L1-03), people in both processes of a forbidden pair (L1-06), unknown approver (L1-07-02), at least
    material (L4-03), after-hours lines of people who post late unusually often (L4-05). Without a chart, accounts in use stand for it."""
    x = gl_timed = X.time_features(gl, s, timed)
    chart = (chart_of_accounts(gl) if chart is None else chart.select("account").distinct()).withColumn("listed", F.lit(True))
    known = people.select("approver").withColumn("known", F.lit(True))
    listed, odd, material = at_once(lambda: small_or_shuffled(chart), lambda: small_or_shuffled(users(gl_timed, s, pairs)), lambda: small_or_shuffled(thresholds(gl, s)))
    x = x.withColumns({"account": F.trim("gl_account"), "approver": plain("approved_by"), "user": F.when(human(s), plain("created_by")), "base": base_amount()})
    x = x.join(listed, "account", "left").join(known, "approver", "left").join(odd, "user", "left").join(material, ["company_code", "fiscal_year"], "left")
    return held(x, {
        "L1-03": ~blank("account") & F.col("listed").isNull(), "L1-06": F.array_contains("hit", F.col("business_process")), "L1-07-02": ~blank("approver") & F.col("known").isNull(), "L4-03": F.col("base") >= F.col("pm"),
        "L4-05": F.col("is_after_hours") & F.col("late_hot"),
    }, {"L4-05": 0.45})


def documents(gl: DataFrame) -> DataFrame:
    """One row per document and company."""
    return gl.filter(F.col("document_id").isNotNull()).groupBy("document_id", "company_code").agg(
        F.min("posting_date").alias("posting_date"), F.max("document_type").alias("document_type"), F.max("business_process").alias("process"), F.max("reference").alias("reference"), F.max("trading_partner").alias("partner"),
        F.greatest(F.sum(zero("debit_amount")), F.sum(zero("credit_amount"))).alias("amount"), F.max(F.coalesce(plain("source").isin("manual", "adjustment"), F.lit(False))).alias("manual"),
    )


def plain_reference(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), "[^0-9A-Z가-힣]", "")
    return F.when(t != "", t)


def duplicate_payment_pairs(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(later, earlier, kind): an earlier document of the same company and partner whose amount is within the tolerance of the later's, with the same reference (however far back), or
    without one on both sides within the window. The tolerance is min(2 % of the later amount, cap), at least 1.

    Amounts are cut into logarithmic bins as wide as the tolerance, of which each later document looks into three, so that the join is on equal keys."""
    # 2 % is the widest relative band, so amounts that match are at most one bin apart; below 50 the absolute band of 1 is wider, so such amounts share one bin
    width = -math.log1p(-s.duplicate_tolerance) * 1.0001
    d = docs.filter(~blank("partner") & (F.col("amount") > 0)).withColumns({
        "ref": plain_reference(F.col("reference")), "bin": F.when(F.col("amount") < 100, F.lit(0).cast("bigint")).otherwise(F.floor(F.log(F.col("amount") / 100) / width) + 1), "day": F.datediff(F.col("posting_date").cast("date"), F.lit("1970-01-01").cast("date")),
    })
    key = ["company_code", "partner", "k"]
    later = d.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    same = d.filter("ref is not null").withColumn("k", F.concat_ws("|", "ref", F.col("bin").cast("string")))
    same_l = later.filter("ref is not null").withColumn("k", F.concat_ws("|", "ref", F.col("bin").cast("string")))
    # without a reference only days within the window match: cells of the window's length, the later looks into its own and the one before
    cell = F.floor(F.col("day") / (s.duplicate_days + 1))
    none = d.filter("ref is null and day is not null").withColumn("k", F.concat_ws("|", F.lit("-"), F.col("bin").cast("string"), cell.cast("string")))
    none_l = later.filter("ref is null and day is not null").withColumn("c", F.explode(F.array(cell, cell - 1))).withColumn("k", F.concat_ws("|", F.lit("-"), F.col("bin").cast("string"), F.col("c").cast("string")))

    def joined(a: DataFrame, b: DataFrame, kind: str, days: int | None) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        on = reduce(lambda p, q: p & q, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in key))
        before = (F.col("b.posting_date") < F.col("a.posting_date")) | ((F.col("b.posting_date") == F.col("a.posting_date")) & (F.col("b.document_id") < F.col("a.document_id")))
        band = F.greatest(F.least(F.col("a.amount") * s.duplicate_tolerance, F.lit(s.duplicate_cap)), F.lit(1.0))
        on = on & before & (F.abs(F.col("a.amount") - F.col("b.amount")) <= band)
        if days is not None:
            on = on & (F.col("a.day") - F.col("b.day") <= days)
        return a.join(b, on).select(F.col("a.document_id").alias("later"), F.col("b.document_id").alias("earlier"), F.lit(kind).alias("kind"))

    return joined(same_l, same, "reference", None).unionByName(joined(none_l, none, "blank", s.duplicate_days)).distinct()


def recurring(docs: DataFrame, keys: list[str], least: int = 3, days: tuple[int, int] = (21, 100), spread: float = 0.20) -> DataFrame:
    """(keys, median, varied) of series of documents that recur at a regular interval: of the gaps between neighbours that are within `days`, the deviation is at most `spread` of the median. Documents
    of one day are summed first, as gaps within a day do not count."""
    d = docs.filter("posting_date is not null").groupBy(*keys, "day").agg(F.min("posting_date").alias("lo"), F.max("posting_date").alias("hi"), F.count(F.lit(1)).alias("c"), F.min(F.coalesce("ref", F.lit(""))).alias("r0"), F.max(F.coalesce("ref", F.lit(""))).alias("r1"))
    gap = F.floor(F.timestamp_diff("SECOND", F.lag("hi").over(Window.partitionBy(*keys).orderBy("day")), F.col("lo")) / 86400)
    g = d.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap").between(*days), F.col("gap").cast("double")))
    g = g.groupBy(*keys).agg(F.sum("c").alias("n"), F.median("gap").alias("median"), F.stddev_pop("gap").alias("sd"), F.count("gap").alias("k"), (F.min("r0") != F.max("r1")).alias("varied"))
    return g.filter((F.col("n") >= least) & (F.col("k") >= max(1, least - 2)) & (F.col("sd") / F.col("median") <= spread)).select(*keys, "median", "varied")


def duplicate_payment_matches(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(document_id, earlier, kind): each later document with its best earlier one, in stages. reference: as in duplicate_payment_pairs. Else, unless it belongs to a recurring series of its exact
    amount: mixed (it has no reference, the earlier has one, however far back), amount (it has another reference than the earlier, or the earlier has none) or blank (neither has one) within the window. Of a recurring
    series, near_extra: a manual document within half the partner's usual interval (references varied) of such an earlier one. Within a kind the nearest earlier document is named."""
    width = -math.log1p(-s.duplicate_tolerance) * 1.0001
    d = docs.filter(~blank("partner") & (F.col("amount") > 0) & F.col("posting_date").isNotNull()).withColumns({
        "ref": plain_reference(F.col("reference")), "bin": F.when(F.col("amount") < 100, F.lit(0).cast("bigint")).otherwise(F.floor(F.log(F.col("amount") / 100) / width) + 1), "day": F.datediff(F.col("posting_date").cast("date"), F.lit("1970-01-01").cast("date")),
    })
    series, usual = recurring(d, ["company_code", "partner", "amount"]), recurring(d, ["company_code", "partner"]).filter("varied")
    d = written(
        d.join(series.select("company_code", "partner", "amount", F.lit(True).alias("series")), ["company_code", "partner", "amount"], "left")
        .join(usual.select("company_code", "partner", F.greatest(F.lit(1.0), F.col("median") * 0.5).alias("near")), ["company_code", "partner"], "left")
        .select("document_id", "company_code", "partner", "posting_date", "amount", "ref", "bin", "day", "manual", F.coalesce("series", F.lit(False)).alias("series"), "near"), "payments",
    )
    later = d.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    cell = F.floor(F.col("day") / (s.duplicate_days + 1))
    celled, celled_l = d.withColumn("k", cell), later.withColumn("k", F.explode(F.array(cell, cell - 1)))

    def joined(a: DataFrame, b: DataFrame, rank: int, key: list[str], also: Column | None = None) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        on = reduce(lambda p, q: p & q, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["company_code", "partner", "bin", *key]))
        before = (F.col("b.posting_date") < F.col("a.posting_date")) | ((F.col("b.posting_date") == F.col("a.posting_date")) & (F.col("b.document_id") < F.col("a.document_id")))
        on = on & before & (F.abs(F.col("a.amount") - F.col("b.amount")) <= F.greatest(F.least(F.col("a.amount") * s.duplicate_tolerance, F.lit(s.duplicate_cap)), F.lit(1.0)))
        gap = F.floor(F.timestamp_diff("SECOND", F.col("b.posting_date"), F.col("a.posting_date")) / 86400)
        close = (F.col("a.day") - F.col("b.day") <= s.duplicate_days) & (gap <= F.col("a.near")) & F.col("a.manual")
        x = a.join(b, on if also is None else on & also)
        # in a series only near_extra counts, after all else
        r = F.when(~F.col("a.series") | F.lit(rank == 0), rank).when(close, 4)
        return x.select("a.document_id", r.alias("rank"), F.col("b.posting_date").alias("at"), F.col("b.document_id").alias("earlier")).filter("rank is not null")

    within = F.col("a.day") - F.col("b.day") <= s.duplicate_days
    pairs = [
        joined(later.filter("ref is not null"), d.filter("ref is not null"), 0, ["ref"]), joined(later.filter("ref is null"), d.filter("ref is not null"), 1, []),
        joined(celled_l.filter("ref is not null"), celled, 2, ["k"], within & ~F.col("a.ref").eqNullSafe(F.col("b.ref"))), joined(celled_l.filter("ref is null"), celled.filter("ref is null"), 3, ["k"], within),
    ]
    best = reduce(DataFrame.unionByName, pairs).groupBy("document_id").agg(F.max(F.struct((-F.col("rank")).alias("r"), "at", "earlier")).alias("x"))
    kinds = F.array(*(F.lit(k) for k in ("reference", "mixed", "amount", "blank", "near_extra")))
    return best.select("document_id", F.col("x.earlier").alias("earlier"), F.element_at(kinds, 1 - F.col("x.r")).alias("kind"))


def duplicate_payments(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    docs = documents(gl).filter((F.col("process") == "P2P") & F.col("document_type").isin("KZ", "KR"))
    later = duplicate_payment_pairs(docs, s).select(F.col("later").alias("document_id")).distinct()
    return flags(gl.join(later, "document_id", "left_semi"), "L2-02")


def duplicate_entries(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Lines that another document repeats in account, amount, time, side, partner and text."""
    x = gl.withColumns({"base": base_amount(), "side": F.when(zero("debit_amount") > 0, "D").otherwise("C"), "text": F.regexp_replace(plain("line_text"), r"[^0-9a-z가-힣 ]", "")})
    x = x.filter(F.col("document_id").isNotNull() & F.col("posting_date").isNotNull() & (F.col("base") > 0) & ~blank("trading_partner") & ~blank("text"))
    key = ["gl_account", "base", "posting_date", "side", "trading_partner", "text"]
    twice = x.groupBy(*key).agg((F.max("document_id") != F.min("document_id")).alias("twice")).filter("twice")
    return flags(x.join(twice, key, "left_semi"), "L2-03")


def account_nets(gl: DataFrame) -> DataFrame:
    """(document_id, company_code, gl_account, net, cents, day): documents' net amounts on accounts that are not zero, with the day."""
    net = gl.filter("document_id is not null and gl_account is not null").groupBy("document_id", "company_code", "gl_account").agg(F.sum(zero("debit_amount") - zero("credit_amount")).alias("net"), F.min("posting_date").alias("at"))
    return net.withColumns({"cents": F.round(F.abs("net") * 100).cast("bigint"), "day": F.datediff(F.col("at").cast("date"), F.lit("1970-01-01").cast("date"))}).filter("cents > 0 and day is not null and company_code is not null")


def reversal_pairs(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(document_id, other, gl_account): documents whose net amounts on an account are equal and opposite within the days. Days are cut into cells of the window's length; one side looks into two."""
    net = account_nets(gl)
    cell = F.floor(F.col("day") / (s.reversal_days + 1))
    up = net.filter("net > 0").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("u")
    down = net.filter("net < 0").withColumn("cell", cell).alias("v")
    on = reduce(lambda p, q: p & q, (F.col(f"u.{c}") == F.col(f"v.{c}") for c in ("company_code", "gl_account", "cents", "cell")))
    on = on & (F.col("u.document_id") != F.col("v.document_id")) & (F.abs(F.col("u.day") - F.col("v.day")) <= s.reversal_days)
    return up.join(down, on).select(F.col("u.document_id").alias("document_id"), F.col("v.document_id").alias("other"), F.col("u.gl_account").alias("gl_account"))


def reversals(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Lines of documents that have a counterpart in reversal_pairs. Whether there is one is read from days on which each side occurs, so no pair is made, however many documents share an amount; windows run over days."""
    key = ["company_code", "gl_account", "cents"]
    net = account_nets(gl)
    days = net.groupBy(*key, "day").agg(F.max(F.col("net") > 0).alias("up"), F.max(F.col("net") < 0).alias("down"))
    w = Window.partitionBy(*key).orderBy("day").rangeBetween(-s.reversal_days, s.reversal_days)
    days = days.withColumns({"near_up": F.max("up").over(w), "near_down": F.max("down").over(w)}).filter("near_up and near_down").select(*key, "day")
    # every document of such a day has the other side within its window: all of one side by definition, and of the other since the window is that of the day
    hit = net.join(days, [*key, "day"], "left_semi").select("document_id", "gl_account").distinct()
    return flags(gl.join(hit, ["document_id", "gl_account"], "left_semi"), "L2-05")


def row_tests(gl: DataFrame, s: Settings = DEFAULT, timed: bool | None = None) -> DataFrame:
    """Tests of one line by itself, in one pass: missing fields, self approval, no approval, wrong period, manual entry, related party, period end, weekend or holiday, after hours, date gap, suspense account."""
    x = X.pattern_features(X.time_features(gl, s, timed), s)
    machine = F.coalesce(plain("user_persona") == "automated_system", F.lit(False))
    tests = {
        "L1-02": reduce(lambda a, b: a | b, (blank(c) for c in REQUIRED)), "L1-05": (plain("created_by") == plain("approved_by")) & ~blank("created_by") & ~machine, "L1-07": blank("approved_by"),
        "L1-08": F.col("fiscal_period").between(1, 12) & F.col("fiscal_period_mismatch"), "L3-02": F.col("is_manual_je"), "L3-03": F.col("is_intercompany"), "L3-04": F.col("is_period_end"), "L3-05": F.col("is_weekend") | F.col("is_holiday"),
        "L3-06": F.col("is_after_hours"), "L3-07": F.abs("days_backdated") > s.backdated_days, "L3-09": F.col("is_suspense_account"),
    }
    return held(x, tests)


def revenue_outlier(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    base = base_amount()
    x = X.zscores(gl, F.when(base > 0, F.log(base)), "z", s)
    return flags(x.filter(X.starts(F.col("gl_account"), s.revenue_prefixes) & (F.col("z") > s.zscore)), "L4-01")


def rare_pairs(gl: DataFrame, most: int = 1) -> DataFrame:
    """Documents that hold a pair of debit and credit accounts which at most `most` documents hold. Accounts are made distinct per document and side
    first, so a document has at most as many pairs as the chart has, however many lines it has."""
    x = gl.filter("document_id is not null and gl_account is not null")
    deb = x.filter(zero("debit_amount") > 0).select("document_id", F.col("gl_account").alias("da")).distinct()
    cre = x.filter(zero("credit_amount") > 0).select("document_id", F.col("gl_account").alias("ca")).distinct()
    pairs = deb.join(cre, "document_id")
    rare = pairs.groupBy("da", "ca").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id")).filter(F.col("n") <= most)
    docs = rare.select("document_id") if most == 1 else pairs.join(rare.select("da", "ca"), ["da", "ca"], "left_semi").select("document_id")
    return flags(gl.join(docs.distinct(), "document_id", "left_semi"), "L4-04")


def batch_anomaly(gl: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Automated lines posted in the same second as batch_same_time or more other documents."""
    x = gl.filter(F.coalesce(plain("source").isin(*s.automated_sources), F.lit(False)) & F.col("posting_date").isNotNull())
    at = x.groupBy("posting_date").agg(F.count_distinct("document_id").alias("docs")).filter(F.col("docs") >= s.batch_same_time).select("posting_date")
    return flags(x.join(at, "posting_date", "left_semi"), "L4-06", 0.45)


def number_gaps(gl: DataFrame) -> DataFrame:
    """(company_code, fiscal_year, document_type, document_id, gap, score): the document after a gap in the running numbers of a company, year and type. Neighbours are found within
    blocks of numbers, and the edges of blocks among themselves, so no series is in one task."""
    n = F.regexp_extract("document_id", "([0-9]+)$", 1).try_cast("bigint")
    keys = ["company_code", "fiscal_year", "document_type"]
    d = gl.filter("document_id is not null").select(*keys, "document_id", n.alias("n")).filter("n is not null").distinct().withColumn("block", F.floor(F.col("n") / 100_000))
    w = Window.partitionBy(*keys, "block").orderBy("n")
    inner = d.withColumn("prev", F.lag("n").over(w))
    edge = d.groupBy(*keys, "block").agg(F.max("n").alias("top")).withColumn("before", F.lag("top").over(Window.partitionBy(*keys).orderBy("block"))).drop("top")
    x = inner.join(edge.withColumnsRenamed({k: f"e_{k}" for k in [*keys, "block"]}), reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in [*keys, "block"])))
    x = x.withColumn("gap", F.col("n") - F.coalesce("prev", "before")).filter("gap > 1")
    return x.select(*keys, "document_id", "gap", F.least(F.col("gap") / 10, F.lit(1.0)).alias("score"))


def split_purchases(gl: DataFrame, limit: float = 30_000.0, least: int = 3) -> DataFrame:
    """Lines of a creator, partner and day with at least `least` documents that all stay just within the limit but exceed it together."""
    d = documents(gl).filter("amount > 0").join(gl.groupBy("document_id", "company_code").agg(F.max(plain("created_by")).alias("user")), ["document_id", "company_code"])
    d = d.filter(~blank("partner") & ~blank("user") & F.col("posting_date").isNotNull()).withColumn("day", F.col("posting_date").cast("date"))
    g = d.groupBy("company_code", "user", "partner", "day").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("most"), F.sum("amount").alias("total")).filter((F.col("n") >= least) & (F.col("most") <= limit) & (F.col("total") > limit))
    docs = d.join(g, ["company_code", "user", "partner", "day"], "left_semi").select("document_id", "company_code")
    return flags(gl.join(docs, ["document_id", "company_code"], "left_semi"), "EV01", 0.8)


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    severity: int
    factor: float  # of the kind of evidence: strong 1, medium .75, weak .45
    role: float  # primary 1, booster .65, context .35, population only 0


#: Level, severity, evidence factor and role factor of each test.
RULES = {r.id: r for r in (
    Rule("L1-01", "L1", 5, 1.0, 0.0), Rule("L1-02", "L1", 2, 0.75, 0.0), Rule("L1-03", "L1", 3, 0.75, 0.0), Rule("L1-04", "L1", 3, 1.0, 1.0), Rule("L1-05", "L1", 3, 1.0, 1.0), Rule("L1-06", "L1", 4, 1.0, 1.0),
    Rule("L1-07", "L1", 4, 1.0, 1.0), Rule("L1-07-02", "L1", 4, 1.0, 1.0), Rule("L1-08", "L1", 4, 0.75, 1.0), Rule("L2-01", "L2", 3, 0.75, 1.0), Rule("L2-02", "L2", 3, 1.0, 1.0), Rule("L2-03", "L2", 3, 0.75, 1.0),
    Rule("L2-04", "L2", 4, 0.75, 1.0), Rule("L2-05", "L2", 4, 0.75, 1.0), Rule("L3-02", "L3", 4, 0.75, 1.0), Rule("L3-03", "L3", 4, 0.45, 0.65), Rule("L3-04", "L3", 3, 0.75, 1.0), Rule("L3-05", "L3", 2, 0.45, 0.0),
    Rule("L3-06", "L3", 2, 0.45, 0.0), Rule("L3-07", "L3", 3, 0.75, 1.0), Rule("L3-09", "L3", 3, 0.75, 1.0), Rule("L4-01", "L4", 5, 0.75, 1.0), Rule("L4-03", "L4", 3, 0.75, 1.0), Rule("L4-04", "L4", 2, 0.75, 1.0),
    Rule("L4-05", "L4", 3, 0.45, 0.0), Rule("L4-06", "L4", 2, 0.45, 0.0), Rule("EV01", "L3", 3, 0.45, 0.65),
)}


def all_flags(gl: DataFrame, employees: DataFrame, s: Settings = DEFAULT, only: set[str] | None = None) -> DataFrame:
    """The long table of flags of every test, or of some."""
    people, timed = at_once(lambda: small_or_shuffled(X.masters(employees)), lambda: X.has_times(gl))
    tests: dict[tuple[str, ...], Callable[[], DataFrame]] = {
        ("L1-02", "L1-05", "L1-07", "L1-08", "L3-02", "L3-03", "L3-04", "L3-05", "L3-06", "L3-07", "L3-09"): lambda: row_tests(gl, s, timed), ("L1-01", "L1-04", "L2-01", "L2-04"): lambda: document_tests(gl, people, s),
        ("L1-03", "L1-06", "L1-07-02", "L4-03", "L4-05"): lambda: lookup_tests(gl, people, s=s, timed=timed), ("L2-02",): lambda: duplicate_payments(gl, s), ("L2-03",): lambda: duplicate_entries(gl, s), ("L2-05",): lambda: reversals(gl, s),
        ("L4-01",): lambda: revenue_outlier(gl, s), ("L4-04",): lambda: rare_pairs(gl), ("L4-06",): lambda: batch_anomaly(gl, s), ("EV01",): lambda: split_purchases(gl),
    }
    return reduce(DataFrame.unionByName, at_once(*(f for ids, f in tests.items() if only is None or only & set(ids))))
