"""Derived columns of ledger lines. All but the z-scores are expressions of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import base_amount, blank, plain, zero
from ..session import small_or_shuffled, written
from .skew import joined_by_key


def has_times(df: DataFrame, c: str = "posting_date") -> bool:
    """Whether any timestamp of the column is not midnight (a date-only column says nothing about hours). Reads on until it meets one."""
    return not df.select(c).filter((F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) > 0).isEmpty()


def clock(c: str) -> Column:
    return F.hour(c) + F.minute(c) / 60


def holiday(d: Column, s: Settings) -> Column:
    moving = F.date_format(d, "yyyy-MM-dd").isin(*s.moving_holidays, *s.own_holidays)
    return F.coalesce((F.month(d) * 100 + F.day(d)).isin(*(m * 100 + x for m, x in s.fixed_holidays)) | moving, F.lit(False))


def time_features(df: DataFrame, s: Settings = DEFAULT, timed: bool | None = None) -> DataFrame:
    p, h = F.col("posting_date"), clock("posting_date")
    weekend = F.coalesce(F.weekday(p) >= 5, F.lit(False))
    late = ((h >= s.midnight_start) | (h < s.midnight_end)) if s.midnight_start > s.midnight_end else ((h >= s.midnight_start) & (h < s.midnight_end))
    timed = has_times(df) if timed is None else timed
    kind = F.when(p.isNull(), "unknown").when((h >= 22) | (h < 6), "midnight").when((h >= s.normal_start) & (h < s.normal_end), "normal").otherwise("overtime")
    md = F.month(p) * 100 + F.day(p)
    kind = F.when((kind == "overtime") & ((md >= 1220) | (md <= 115)), "normal").otherwise(kind)
    kind = F.when((kind == "normal") & (weekend | holiday(p, s)), "overtime").otherwise(kind)
    return df.withColumns({
        "is_weekend": weekend,
        "is_holiday": holiday(p, s),
        "is_after_hours": F.coalesce(late, F.lit(False)) if timed else F.lit(False),
        "is_period_end": F.coalesce((F.datediff(F.last_day(p), p) <= s.period_margin) | (F.day(p) <= s.period_margin), F.lit(False)),
        "days_backdated": F.floor(F.timestamp_diff("SECOND", F.col("document_date"), p) / 86400),
        "fiscal_period_mismatch": F.col("fiscal_period") != F.pmod(F.month(p) - s.year_start, F.lit(12)) + 1,
        "time_zone_category": kind,
    })


def is_round(base: Column, s: Settings = DEFAULT) -> Column:
    digits = F.bround(base, 0).cast("decimal(20,0)").cast("string")
    return (base > 0) & (F.abs(base - F.bround(base, 0)) < 1e-9) & (F.length(digits) >= s.round_total) & (F.length(F.regexp_replace(digits, "0+$", "")) <= s.round_digits)


def amount_features(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    d = F.greatest(F.abs(zero("debit_amount")), F.abs(zero("credit_amount")))
    return df.withColumn("base_amount", base_amount()).withColumns({
        "amount_magnitude": F.log10(F.abs("base_amount") + 1),
        "is_round_number": is_round(F.col("base_amount"), s),
        "first_digit": F.regexp_extract(d.cast("decimal(30,6)").cast("string"), "([1-9])", 1).try_cast("int"),
    })


def zscores(df: DataFrame, value: Column, name: str, s: Settings = DEFAULT) -> DataFrame:
    """value against its account if that has enough lines, else against the accounts of the same first digit, else against all.

    Null where there are too few lines in all or value is null; 0 where the spread is 0. The ledger is aggregated once, per account; means and spreads of the wider groups are
    pooled from those of accounts, and each account's are looked up, so a hot account is never in one task."""
    x = df.withColumns({"_v": value, "_a": F.coalesce("gl_account", F.lit(""))})
    acc = x.groupBy("_a").agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("k"), F.coalesce(F.avg("_v"), F.lit(0.0)).alias("m"), F.coalesce(F.var_samp("_v"), F.lit(0.0)).alias("s2"))
    acc = written(acc.withColumn("_c", F.substring("_a", 1, 1)), "accounts")
    spread = lambda mean: F.sum(F.col("s2") * F.greatest(F.col("k") - 1, F.lit(0)) + F.col("k") * F.pow(F.col("m") - mean, 2))
    root = lambda m2, k: F.when(k > 1, F.sqrt(m2 / F.greatest(k - 1, F.lit(1)))).otherwise(0.0)
    within, between = F.sum(F.col("s2") * F.greatest(F.col("k") - 1, F.lit(0))), F.sum(F.col("k") * F.col("m") * F.col("m"))
    one = acc.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.try_divide(F.sum(F.col("k") * F.col("m")), F.sum("k")).alias("m"), within.alias("within"), between.alias("between")).first()
    if not one["k"] or one["n"] < s.zscore_least:
        return df.withColumn(name, F.lit(None).cast("double"))
    whole = max(0.0, one["within"] + one["between"] - one["k"] * one["m"] ** 2)
    w = Window.partitionBy("_c")  # over accounts
    c = acc.withColumn("cm", F.try_divide(F.sum(F.col("k") * F.col("m")).over(w), F.sum("k").over(w))).groupBy("_c").agg(F.sum("n").alias("cn"), F.sum("k").alias("ck"), F.max("cm").alias("cm"), spread(F.col("cm")).alias("cs"))
    pick = lambda a, b, g: F.when(F.col("n") >= s.zscore_group, a).when(F.col("cn") >= s.zscore_group, b).otherwise(F.lit(float(g)))
    look = acc.join(c, "_c").select(
        "_a", pick(F.col("m"), F.col("cm"), one["m"]).alias("_m"), pick(F.sqrt("s2"), root(F.col("cs"), F.col("ck")), (whole / (one["k"] - 1)) ** 0.5 if one["k"] > 1 else 0.0).alias("_s")
    )
    z = F.when(F.col("_s") == 0, F.when(F.col("_v").isNotNull(), 0.0)).otherwise((F.col("_v") - F.col("_m")) / F.col("_s"))
    return joined_by_key(x, look, ["_a"]).withColumn(name, z).drop("_v", "_a", "_m", "_s")


def starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return F.coalesce(out, F.lit(False))


def pattern_features(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    words = "(?i)(" + "|".join(s.suspense_words) + ")"
    return df.withColumns({
        "is_manual_je": F.coalesce(plain("source").isin(*s.manual_sources), F.lit(False)),
        "is_intercompany": F.coalesce(plain("business_process") == "intercompany", F.lit(False)) | F.coalesce(plain("document_type") == "ic", F.lit(False)),
        "is_revenue_account": starts(F.col("gl_account"), s.revenue_prefixes),
        "is_suspense_account": F.coalesce(F.col("line_text").rlike(words), F.lit(False)) | starts(F.col("gl_account"), s.suspense_prefixes),
    })


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; null for null, 0 for empty. One pass over the sorted characters."""
    chars = F.array_sort(F.split(text, ""))
    n = F.size(chars).cast("double")
    state = lambda last, run, done: F.struct(last.alias("last"), run.cast("double").alias("run"), done.cast("double").alias("done"))
    closed = lambda a: a["done"] + a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0)))
    total = F.aggregate(chars, state(F.lit(""), F.lit(0.0), F.lit(0.0)), lambda a, c: F.when(a["last"] == c, state(c, a["run"] + 1, a["done"])).otherwise(state(c, F.lit(1.0), closed(a))), closed)
    return F.when(F.length(text) == 0, 0.0).when(text.isNotNull(), F.log2(n) - total / n)


def text_features(df: DataFrame, column: str = "line_text", s: Settings = DEFAULT) -> DataFrame:
    """The cleaned text is a column of its own first, so that it is made once per row."""
    x = df.withColumn("_clean", F.trim(F.regexp_replace(F.lower(column), r"[ \t\r\n]+", " "))).withColumn("_tokens", F.split("_clean", " "))
    clean, tokens = F.col("_clean"), F.col("_tokens")
    corrupted = clean.rlike("^[ㄱ-ㅎㅏ-ㅣ ]+$") | clean.rlike("^[^0-9a-z가-힣]+$") | clean.rlike(r"^(.)\1{3,}$")
    high, medium = (clean.rlike("(" + "|".join(w) + ")") for w in (s.high_words, s.medium_words))
    return x.withColumns({
        "description_quality": F.when(blank(column), "missing").when(corrupted, "corrupted").otherwise("normal"),
        "token_count": F.when(blank(column), 0).otherwise(F.size(tokens)),
        "type_token_ratio": F.when(blank(column), 0.0).otherwise(F.size(F.array_distinct(tokens)) / F.size(tokens)),
        "char_entropy": entropy(clean),
        "risk_keyword": F.when(high, "high").when(medium, "medium"),
    }).drop("_clean", "_tokens")


def masters(employees: DataFrame) -> DataFrame:
    """(approver, limit, may), one row per user, however spelled: the largest limit and any authority; without authority the limit is 0."""
    m = employees.filter(F.col("user_id").isNotNull()).groupBy(plain("user_id").alias("approver")).agg(F.max("approval_limit").alias("limit"), F.max("can_approve_je").alias("may"))
    return m.withColumn("limit", F.when(F.col("may") == False, 0.0).otherwise(F.col("limit")))  # noqa: E712


def approval_features(df: DataFrame, employees: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The approver's limit and authority against the document's amount."""
    docs = df.groupBy("document_id").agg(F.sum(zero("debit_amount")).alias("document_amount"))
    x = df.withColumn("approver", plain("approved_by")).join(small_or_shuffled(masters(employees)), "approver", "left").join(docs, "document_id", "left")
    a, lim = F.col("document_amount"), F.col("limit")
    return x.withColumns({
        "approver_limit": lim, "approver_known": F.col("may").isNotNull() | lim.isNotNull(),
        "is_near_threshold": F.coalesce((a >= lim * s.near_ratio) & (a < lim), F.lit(False)),
        "exceeds_threshold": F.coalesce(a > lim, F.lit(False)),
    }).drop("approver", "limit", "may")


def approval_details(df: DataFrame, employees: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """approval_features with what they rest on: threshold_ratio, threshold_gap, approval_level by the ladder, why a line counts as over its limit, and whether the amount could be judged at all."""
    from .sinks import approval_level

    x = approval_features(df, employees, s)
    a, lim = F.col("document_amount"), F.col("approver_limit")
    return x.withColumns({
        "threshold_ratio": F.try_divide(a, lim), "threshold_gap": lim - a, "approval_level": approval_level(a, s.approval_ladder), "amount_resolved": a.isNotNull() & lim.isNotNull(),
        "over_reason": F.when(F.col("exceeds_threshold") & (lim == 0), "no_authority").when(F.col("exceeds_threshold"), "over_limit").when(F.col("is_near_threshold"), "near_limit"),
    })


def description_profile(df: DataFrame, keys: list[str], column: str = "line_text", s: Settings = DEFAULT) -> DataFrame:
    """Per group: lines, how many have no text, a corrupted one, a risk word, and the mean number of tokens."""
    x = text_features(df.select(*keys, column), column, s)
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("description_quality") == "missing").alias("missing"), F.count_if(F.col("description_quality") == "corrupted").alias("corrupted"), F.count("risk_keyword").alias("risk_words"), F.avg("token_count").alias("mean_tokens"),
    )
