"""Folding flags into row scores, levels and review units; ranking and fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import melted, quantiles, running_count
from ..session import at_once
from .rules import RULES
from .skew import joined_by_key

#: Weight of each level in a row's score, and the lower bounds of the risk levels.
LEVEL_WEIGHTS = {"L1": 0.40, "L2": 0.25, "L3": 0.20, "L4": 0.15}
RISK = (("High", 0.50), ("Medium", 0.25), ("Low", 0.10))
RISK_QUANTILES = (("High", 0.90), ("Medium", 0.75), ("Low", 0.50))
#: Tests whose signal does not depend on their severity, the topic of each test, and its share in a case's priority.
PLAIN_SIGNAL = ("L1-03", "L1-07", "L4-04")
TOPICS = {
    "L1-01": "ledger_integrity", "L1-02": "ledger_integrity", "L1-03": "ledger_integrity", "L1-04": "approval_control", "L1-05": "approval_control", "L1-06": "approval_control", "L1-07": "approval_control", "L1-07-02": "approval_control",
    "L1-08": "closing_timing", "L2-01": "duplicate_outflow", "L2-02": "duplicate_outflow", "L2-03": "duplicate_outflow", "L2-04": "account_logic", "L2-05": "duplicate_outflow", "L3-02": "approval_control", "L3-03": "account_logic",
    "L3-04": "closing_timing", "L3-05": "closing_timing", "L3-06": "closing_timing", "L3-07": "closing_timing", "L3-09": "account_logic", "L4-01": "revenue_statistical", "L4-03": "revenue_statistical", "L4-04": "account_logic",
    "L4-05": "closing_timing", "L4-06": "revenue_statistical", "EV01": "duplicate_outflow",
}
PRIORITY = {"approval_control": 0.25, "duplicate_outflow": 0.15, "account_logic": 0.15, "closing_timing": 0.10, "revenue_statistical": 0.10}
PRIORITY_AMOUNT = 0.25
#: Tests whose strong flags make a row High whatever else it has, and from which score on.
FLOOR_RULES, FLOOR_SCORE = ("L1-04",), 0.8


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(r.id, r.level, r.severity, r.factor, r.role) for r in RULES.values()], "rule_id string, level string, severity int, factor double, role double")


def evidence(flags: DataFrame) -> DataFrame:
    """Flags with their normalised strength: signal x severity / 5 x evidence factor x role factor, within 0..1. The signal is the flag's score if above severity / 5, else that share of it; of some
    tests (PLAIN_SIGNAL) the severity is left out again."""
    x = flags.join(F.broadcast(registry(flags.sparkSession)), "rule_id")  # a row per test
    sev, v = F.col("severity") / 5, F.greatest(F.col("score"), F.lit(0.0))
    signal = F.when(F.col("rule_id").isin(*PLAIN_SIGNAL), F.least(v, F.lit(1.0)) / sev).otherwise(F.least(F.when(v > sev, v).otherwise(v / sev), F.lit(1.0)))
    return x.withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), signal * sev * F.col("factor") * F.col("role"))))


def row_scores(flags: DataFrame) -> DataFrame:
    """(row_id, anomaly_score, risk_level, flagged_rules): the weighted sum over levels of each level's strongest evidence. Rows with an integrity flag and at least two others are High."""
    e = evidence(flags)
    best = lambda lv: F.max(F.when(F.col("level") == lv, F.col("strength")).otherwise(0.0))
    g = e.groupBy("row_id").agg(
        *(best(lv).alias(lv) for lv in LEVEL_WEIGHTS), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("flagged_rules"),
        F.count(F.when(F.col("rule_id").isin("L1-01", "L1-02", "L1-03"), 1)).alias("integrity"), F.count(F.lit(1)).alias("rules"),
    )
    score = reduce(lambda a, b: a + b, (F.col(lv) * w for lv, w in LEVEL_WEIGHTS.items()))
    g = g.withColumn("anomaly_score", F.round(score, 6))
    up = (F.col("integrity") >= 1) & (F.col("rules") - F.col("integrity") >= 2)
    return g.select("row_id", "anomaly_score", F.when(up, "High").otherwise(risk_level(F.col("anomaly_score"))).alias("risk_level"), "flagged_rules")


def risk_level(score: Column) -> Column:
    out = F.lit("Normal")
    for name, least in reversed(RISK):
        out = F.when(score >= least, name).otherwise(out)
    return out


def quantile_levels(scores: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """scores with risk_level by the share of rows that score at most as much; rows at 0 and below are Normal."""
    some = scores.filter(F.col(score).isNotNull())
    r = running_count(some, score, "_r").select(score, (F.col("_r") / F.col("_all")).alias("_p"))
    level = F.lit("Normal")
    for name, q in reversed(RISK_QUANTILES):
        level = F.when(F.col("_p") > q, name).otherwise(level)
    return joined_by_key(some, r, [score]).withColumn("risk_level", F.when(F.col(score) <= 0, "Normal").otherwise(level)).drop("_p")


def policy_floors(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """scores raised to High where a test that must not be diluted is flagged strongly, with the reasons."""
    f = flags.filter(F.col("rule_id").isin(*FLOOR_RULES) & (F.col("score") >= FLOOR_SCORE)).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("rule_id", F.lit(":immediate")))), ",").alias("reasons"))
    x, up = scores.join(f, "row_id", "left"), F.col("reasons").isNotNull()
    return x.withColumns({"anomaly_score": F.when(up, F.greatest("anomaly_score", F.lit(dict(RISK)["High"]))).otherwise(F.col("anomaly_score")), "risk_level": F.when(up, "High").otherwise(F.col("risk_level")), "reasons": F.coalesce("reasons", F.lit(""))})


def rule_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule_id").agg(F.count(F.lit(1)).alias("flagged"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"))


def document_units(flags: DataFrame, gl: DataFrame) -> DataFrame:
    """One review unit per document: which tests fired, how many lines, the amount of its lines."""
    from ..functions import base_amount

    per = flags.groupBy("row_id").agg(F.collect_set("rule_id").alias("fired"))  # bounded by the number of tests
    x = gl.filter("document_id is not null").select("row_id", "document_id", base_amount().alias("amount")).join(per, "row_id")
    return x.groupBy("document_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("fired")))).alias("fired"), F.count(F.lit(1)).alias("lines"), F.round(F.sum("amount"), 2).alias("amount"))


def combine(units: DataFrame, bodies: list[str], features: list[str], strict: bool = False) -> DataFrame:
    """Units that fired any of the bodies and any of the features (strict: all of both). An empty choice does not restrict; two empty ones choose nothing."""
    if not bodies and not features:
        return units.limit(0)
    cond = F.lit(True)
    for chosen in (bodies, features):
        if chosen:
            arr = F.array(*map(F.lit, chosen))
            cond = cond & ((F.size(F.array_except(arr, "fired")) == 0) if strict else F.arrays_overlap("fired", arr))
    return units.filter(cond)


def rank_of(df: DataFrame, key: str, value: str, name: str, descending: bool = True) -> DataFrame:
    """(key, name): the rank (1 + rows that are better; equal values share one; null without a value), from counts of distinct values, so no task sorts all rows."""
    some = df.filter(F.col(value).isNotNull())
    ranks = running_count(some.select(value), value, "_r", descending=descending).select(value, (F.col("_r") - F.col("_c") + 1).alias(name))
    return joined_by_key(some, ranks, [value]).select(key, name).unionByName(df.filter(F.col(value).isNull()).select(key, F.lit(None).cast("bigint").alias(name)))


def reciprocal_rank_fusion(df: DataFrame, key: str, scores: list[str], k: int = 60) -> DataFrame:
    """(key, rrf): the sum of 1 / (k + rank) over the rankers; a null score does not count. Keys must be unique."""
    out = df.select(key)
    for r in at_once(*((lambda c=c: rank_of(df.select(key, c).filter(F.col(c).isNotNull()), key, c, f"r_{c}")) for c in scores)):
        out = out.join(r, key, "left")
    return out.select(key, reduce(lambda a, b: a + b, (F.coalesce(1 / (k + F.col(f"r_{c}")), F.lit(0.0)) for c in scores)).alias("rrf"))


def noisy_or(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """(key, noisy_or): 1 - product of (1 - ecdf) over the scores' zero-preserving ECDFs. Keys must be unique."""
    from ..functions import ecdf

    out = df.select(key)
    for e in at_once(*((lambda c=c: ecdf(df.select(key, c).filter(F.col(c) > 0), c, f"e_{c}").select(key, f"e_{c}")) for c in scores)):
        out = out.join(e, key, "left")
    out = out.na.fill(0.0, [f"e_{c}" for c in scores])
    return out.select(key, (1 - reduce(lambda a, b: a * b, (1 - F.col(f"e_{c}") for c in scores))).alias("noisy_or"))


def theme_ranks(cases: DataFrame, theme: str, score: str, id_col: str, n: int) -> DataFrame:
    """The n first of each theme by a window (the optimiser cuts each task's part to n per theme before the shuffle)."""
    w = Window.partitionBy(theme).orderBy(F.desc(score), id_col)
    return cases.filter(F.col(theme).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def precision_recall(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """flags (rule_id, document_id), truth (rule_id, document_id) -> tp, fp, fn, precision, recall per rule."""
    f, t = flags.select("rule_id", "document_id").distinct().withColumn("f", F.lit(1)), truth.select("rule_id", "document_id").distinct().withColumn("t", F.lit(1))
    g = f.join(t, ["rule_id", "document_id"], "full").groupBy("rule_id").agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
    return g.withColumns({"precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), "recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))})


def latest_decisions(events: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """The last event of each key (ties: the higher id), by a mergeable maximum."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, id_col)).alias("_e")).select(key, "_e.*")


def boosted_fusion(df: DataFrame, key: str, scores: list[str], booster: str, q: float = 0.95, k: int = 60) -> DataFrame:
    """(key, rrf): rank fusion in which one more ranker counts only for rows at or above its own q-quantile of positive scores."""
    edge = quantiles(df.filter(F.col(booster) > 0), booster, {"edge": q}).first()[0]
    base = reciprocal_rank_fusion(df, key, scores, k)
    if edge is None:
        return base
    top = rank_of(df.filter(F.col(booster) >= F.lit(edge)).select(key, booster), key, booster, "r")
    return base.join(top, key, "left").select(key, (F.col("rrf") + F.coalesce(1 / (k + F.col("r")), F.lit(0.0))).alias("rrf"))


def score_diagnostics(df: DataFrame, scores: list[str]) -> DataFrame:
    """(score_name, n, non_zero_rate, distinct_share, top_tie_share): whether a score can rank at all, and how many rows share its highest value."""
    v = melted(df, scores, "double").groupBy(F.col("column_name").alias("score_name"), F.coalesce("v", F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    g = v.groupBy("score_name").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("v") != 0, F.col("k")).otherwise(0)).alias("z"), F.count(F.lit(1)).alias("d"), F.max(F.struct("v", "k")).alias("top"))
    return g.select("score_name", "n", F.try_divide("z", "n").alias("non_zero_rate"), F.try_divide("d", "n").alias("distinct_share"), F.try_divide("top.k", "n").alias("top_tie_share"))


def topside(flags: DataFrame) -> DataFrame:
    """(row_id, topside): of manual lines, how many of four groups of signs are there (period end, bypassed approval, unusual pattern, large amount), as a share."""
    fired = lambda *r: F.max(F.col("rule_id").isin(*r).cast("int"))
    g = flags.groupBy("row_id").agg(fired("L3-02").alias("m"), fired("L3-04", "L3-07").alias("p"), fired("L1-05", "L1-07", "L1-04").alias("b"), fired("L4-04", "L2-03", "L2-05").alias("u"), fired("L4-01", "L4-03").alias("a"))
    return g.filter("m = 1").select("row_id", ((F.col("p") + F.col("b") + F.col("u") + F.col("a")) / 4).alias("topside"))


def coverage(units: DataFrame) -> DataFrame:
    """(rule_id, units, alone): in how many review units each test fired, and in how many alone."""
    return units.select(F.explode("fired").alias("rule_id"), (F.size("fired") == 1).alias("one")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("units"), F.count(F.when(F.col("one"), 1)).alias("alone"))
