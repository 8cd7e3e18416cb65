"""Cases for review: units of documents and flows with their tiers, order, priority and queues. Units are one row per document or flow; nothing here runs over lines but the first aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import base_amount, running_count
from ..session import small_or_shuffled, written
from .rules import RULES
from .scoring import PRIORITY, PRIORITY_AMOUNT, TOPICS, evidence


def topic_table(spark) -> DataFrame:
    """(rule_id, topic, primary): the topic of each test, and whether it stands alone (its role factor is full)."""
    return spark.createDataFrame([(r, TOPICS[r], RULES[r].role == 1.0) for r in RULES], "rule_id string, topic string, primary boolean")


def document_evidence(flags: DataFrame, gl: DataFrame) -> DataFrame:
    """(document_id, rule_id, strength, lines): each test's strongest evidence per document."""
    e = evidence(flags).select("row_id", "rule_id", "strength")
    return gl.filter("document_id is not null").select("row_id", "document_id").join(e, "row_id").groupBy("document_id", "rule_id").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("lines"))


def topic_tiers(ev: DataFrame) -> DataFrame:
    """(document_id, topic, tier): LOW where a test that stands alone has evidence, else CONTEXT."""
    x = ev.join(F.broadcast(topic_table(ev.sparkSession)), "rule_id")  # a row per test
    return x.groupBy("document_id", "topic").agg(F.when(F.max(F.col("primary") & (F.col("strength") > 0)), "LOW").otherwise("CONTEXT").alias("tier"))


def cases(ev: DataFrame, gl: DataFrame, materiality: float = 0.0) -> DataFrame:
    """One case per document: (document_id, tier, primaries, rules, amount, amount_score, sort_score, priority). sort_score packs tier, number of tests that stand alone, number of tests and amount, in this order of weight;
    priority is the weighted sum of the topics' strongest evidence and the amount. The amount counts in proportion to the largest case, or to the materiality if that is more."""
    x = ev.join(F.broadcast(topic_table(ev.sparkSession)), "rule_id")
    best = [F.max(F.when(F.col("topic") == t, F.col("strength")).otherwise(0.0)).alias(f"_{t}") for t in PRIORITY]
    g = x.groupBy("document_id").agg(F.max(F.col("primary") & (F.col("strength") > 0)).alias("low"), F.count_if("primary").alias("primaries"), F.count(F.lit(1)).alias("rules"), *best)
    amounts = gl.filter("document_id is not null").groupBy("document_id").agg(F.round(F.sum(base_amount()), 2).alias("amount"))
    g = written(g.join(amounts, "document_id"), "cases")
    most = g.agg(F.max("amount")).first()[0] or 1.0
    share = F.least(F.col("amount") / F.lit(most), F.lit(1.0))
    if materiality > 0:
        share = F.greatest(share, F.least(F.col("amount") / materiality, F.lit(1.0)))
    g = g.withColumn("amount_score", F.greatest(F.lit(0.0), share))
    order = F.when(F.col("low"), 1_000_000).otherwise(0) + F.least("primaries", F.lit(99)) * 10_000 + F.least("rules", F.lit(99)) * 100 + F.bround(F.col("amount_score") * 99, 0)
    priority = reduce(lambda a, b: a + b, (F.col(f"_{t}") * w for t, w in PRIORITY.items())) + F.col("amount_score") * PRIORITY_AMOUNT
    return g.select("document_id", F.when(F.col("low"), "LOW").otherwise("CONTEXT").alias("tier"), "primaries", "rules", "amount", "amount_score", order.cast("double").alias("sort_score"), priority.alias("priority"))


def chains(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """pairs (document_id, earlier), each document at most once as document_id -> (document_id, root): to which first document each leads. Pointers are doubled until none moves, so a chain of n takes log2 n
    rounds, each a join of the table with itself, written in between."""
    edges = pairs.groupBy("document_id").agg(F.min("earlier").alias("root"))
    roots = edges.select(F.col("root").alias("document_id")).join(edges.select("document_id"), "document_id", "left_anti").distinct()
    p = written(edges.unionByName(roots.withColumn("root", F.col("document_id"))), "chain")
    for _ in range(rounds):
        up = p.select(F.col("document_id").alias("root"), F.col("root").alias("_up"))
        q = written(p.join(up, "root").select("document_id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "chain")
        p = q.drop("moved")
        if q.filter("moved").isEmpty():
            break
    return p


def without(units: DataFrame, flow: DataFrame) -> DataFrame:
    """Document units that no flow unit has taken in."""
    return units.join(small_or_shuffled(flow.select("document_id").distinct()), "document_id", "left_anti")


def queues(parts: dict[str, DataFrame], n: int) -> DataFrame:
    """(queue, place, unit_id, score): of each queue's units (unit_id, score) the n first by score, then unit."""
    out = None
    for name, df in parts.items():
        q = df.select(F.lit(name).alias("queue"), F.col("unit_id").cast("string").alias("unit_id"), F.col("score").cast("double").alias("score"))
        out = q if out is None else out.unionByName(q)
    w = Window.partitionBy("queue").orderBy(F.desc("score"), "unit_id")  # cut to n in each task first
    return out.filter("score is not null").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("queue", "place", "unit_id", "score")


#: The shares of cases, by rank, of the review bands.
BANDS = (("immediate", 0.0125), ("review", 0.05), ("candidate", 0.25))


def rank_bands(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, band) by the rank of the score (equal scores share the better): within the first ceil(share x cases); no score or none above 0 gives none."""
    from .scoring import rank_of

    n = df.count()
    r = rank_of(df.select(key, F.when(F.col(score) > 0, F.col(score)).alias(score)), key, score, "_r")
    band = F.lit("none")
    for name, share in reversed(BANDS):
        band = F.when(F.col("_r") <= max(1, -int(-(n * share) // 1)), name).otherwise(band)
    return r.select(key, F.when(F.col("_r").isNull(), "none").otherwise(band).alias("band"))


def joint_band(a: str, b: str):
    """The band of two: immediate if both are, review if either is at least that, candidate if either is, else none."""
    x, y = F.coalesce(F.lower(F.trim(a)), F.lit("none")), F.coalesce(F.lower(F.trim(b)), F.lit("none"))
    either = lambda v: (x == v) | (y == v)
    return F.when((x == "immediate") & (y == "immediate"), "immediate").when(either("immediate") | either("review"), "review").when(either("candidate"), "candidate").otherwise("none")


def tier_band(tier: str, breadth: str, ecdf: str, ml: str, signal: str):
    """The band of the second phase: strong evidence with a breadth of 2 or more is immediate, other strong or moderate with 2 is review, as is a model's quantile of .99 or more with 2; any signal is a candidate."""
    t, n = F.coalesce(F.lower(F.trim(tier)), F.lit("")), F.coalesce(F.col(breadth), F.lit(0))
    model = (t == "ml_quantile") & (F.coalesce(F.col(ecdf), F.lit(0.0)) >= 0.99) & (n >= 2) & F.coalesce(F.col(ml), F.lit(False))
    return F.when((t == "strong") & (n >= 2), "immediate").when((t == "strong") | ((t == "moderate") & (n >= 2)) | model, "review").when(F.coalesce(F.col(signal), F.lit(False)), "candidate").otherwise("none")


def linked(a: DataFrame, b: DataFrame, ref: str) -> DataFrame:
    """(ref_hash, a_units, b_units): references that both phases' units (unit_id, ref) name, matched by a digest of the reference's plain form."""
    h = F.substring(F.sha2(F.lower(F.trim(ref)), 256), 1, 24).alias("ref_hash")
    side = lambda x, n: x.filter(F.col(ref).isNotNull()).groupBy(h).agg(F.count_distinct("unit_id").alias(n))
    return side(a, "a_units").join(side(b, "b_units"), "ref_hash")


def ordered_by_ladder(df: DataFrame, ladder: list[str], key: str, n: int) -> DataFrame:
    """The n first cases by the ladder of columns, each descending, nulls last, then by key: a later column only decides where all before are equal."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in ladder), key).limit(n)


def recall_at_k(df: DataFrame, group: str, scenario: str, score: str, top: float = 0.01, folds: int = 5) -> DataFrame:
    """(fold, scenario, n_truth, n_hit, recall, k, fold_size): of each fold (groups by digest, never split) and scenario how many cases are among the k = max(1, floor(top x size)) best, all that tie with the last included."""
    from .learn import bucket

    x = df.filter(F.col(score).isNotNull()).select(bucket(F.col(group), folds).cast("int").alias("fold"), F.col(scenario).alias("scenario"), F.col(score).cast("double").alias("_s"))
    r = running_count(x.select("fold", "_s"), "_s", "_r", ["fold"], descending=True)
    k = F.greatest(F.lit(1), F.floor(F.col("_all") * top))
    # the k-th best is the largest value at or below which k rows lie
    edge = r.withColumn("k", k).filter(F.col("_r") >= F.col("k")).groupBy("fold").agg(F.max("_s").alias("_edge"), F.max("k").alias("k"), F.max("_all").alias("fold_size"))
    y = x.join(F.broadcast(edge), "fold")  # a row per fold
    g = y.filter(F.col("scenario").isNotNull()).groupBy("fold", "scenario", "k", "fold_size").agg(F.count(F.lit(1)).alias("n_truth"), F.count_if(F.col("_s") >= F.col("_edge")).alias("n_hit"))
    return g.withColumn("recall", F.col("n_hit") / F.col("n_truth"))


def bootstrap(hits: DataFrame, n_boot: int = 1000, seed: int = 2026, wide: float = 0.5) -> DataFrame:
    """hits (scenario, n_truth, n_hit) -> with point_recall, ci_lo, ci_hi and whether the interval is too wide to say anything. Drawing n of n cases again is drawing from a binomial; on aggregated rows, one per scenario."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            rng = np.random.default_rng(seed)
            got = [np.quantile(rng.binomial(int(n), h / n, n_boot) / n, [0.025, 0.975]) if n else (np.nan, np.nan) for n, h in zip(b["n_truth"], b["n_hit"], strict=True)]
            lo, hi = (pd.Series([g[j] for g in got], index=b.index, dtype="float64") for j in (0, 1))
            yield b.assign(point_recall=b["n_hit"] / b["n_truth"], ci_lo=lo, ci_hi=hi, insignificant=(hi - lo) > wide)

    one = hits.groupBy("scenario").agg(F.sum("n_truth").alias("n_truth"), F.sum("n_hit").alias("n_hit"))
    return one.coalesce(1).sortWithinPartitions("scenario").mapInPandas(run, "scenario string, n_truth long, n_hit long, point_recall double, ci_lo double, ci_hi double, insignificant boolean")


def operational_report(gl: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: documents, those with any flag, those with a High line, and their share."""
    x = gl.select("row_id", "document_id").join(scores.select("row_id", "risk_level", "flagged_rules"), "row_id", "left").filter("document_id is not null")
    d = x.groupBy("document_id").agg(F.max(F.col("flagged_rules").isNotNull()).alias("f"), F.max(F.coalesce(F.col("risk_level") == "High", F.lit(False))).alias("h"))
    g = d.agg(F.count(F.lit(1)).alias("total_docs"), F.count_if("f").alias("flagged_docs"), F.count_if("h").alias("high_risk_docs"))
    return g.withColumn("high_risk_ratio", F.coalesce(F.try_divide("high_risk_docs", "total_docs"), F.lit(0.0)))
