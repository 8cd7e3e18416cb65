"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and including it, in a shuffled order, divided by the source's
weight. In the order of these times every source has, at any moment, got its share. The mix is that order, cut off at the
total budget. A source is repeated by letting it queue again, in a new order, at most max_repeats times in all.

The running sums are made in two steps (sums of hash bins, then within a bin), so neither a source nor the whole order is
ever in one task.

Defined results: documents of sources without a target, with a null source or without tokens take no part; a listed source without
documents has the actual share 0, and the others divide its share in proportion to their weights; without a budget, the
budget is the largest total at which every present source still has its share within its repeats; rows of equal id
are told apart by nothing else and count each; an empty table gives an empty mix. A source lacks at the cut
less than its next document, so a small mix of large documents is as coarse as these are; shares() reports the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .encode import count_tokens

#: Documents per bin of the running sums, about.
PER_BIN = 20_000


def with_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written once."""
    return written(count_tokens(docs.filter(F.col("source").isNotNull()), ["doc_id", "source"], "text", path, pattern), "tokens")


def plan(tokens: DataFrame, targets: DataFrame, budget: int | None = None) -> list[dict]:
    """Per listed source: weight (its part of the shares of present sources), tokens, docs, copies allowed; and the budget in each. As many rows as targets, on the driver."""
    t = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = tokens.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = [r.asDict() for r in t.join(have, "source", "left").collect()]
    present = [r for r in rows if r["tokens"] and (r["max_repeats"] or 1) > 0]
    total = sum(r["target_share"] for r in present)
    most = min((r["tokens"] * (r["max_repeats"] or 1) * total / r["target_share"] for r in present), default=0)
    for r in rows:
        r["weight"] = r["target_share"] / total if r in present else 0.0
        r["budget"] = int(most) if budget is None else int(budget)
    return rows


def mix(tokens: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, finish_time), in the order of the mix."""
    spark = tokens.sparkSession
    rows = [r for r in plan(tokens, targets, budget) if r["weight"] > 0]
    total = rows[0]["budget"] if rows else 0
    n = sum(r["docs"] for r in rows)
    bins = max(16, -(-n // PER_BIN))
    copies = lambda r: int(min(int(r["max_repeats"] or 1), -(-max(1, total) // r["tokens"])))  # no source can take more than the whole budget
    weights = F.broadcast(spark.createDataFrame([(r["source"], r["weight"], copies(r), r["tokens"]) for r in rows], "source string, weight double, copies int, source_tokens bigint"))  # a row per target
    x = tokens.filter("n_tokens > 0").join(weights, "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    x = x.withColumn("h", F.xxhash64("doc_id", "copy_no", F.lit(seed))).withColumn("bin", F.pmod(F.shiftrightunsigned("h", 20), F.lit(bins)))
    key = ["source", "copy_no", "bin"]
    sums = x.groupBy(*key).agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source", "copy_no").orderBy("bin")) - F.col("s")).drop("s")
    inner = Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(before, key).withColumn("cum", F.sum("n_tokens").over(inner) + F.col("before") + (F.col("copy_no") - 1) * F.col("source_tokens"))
    x = written(x.select("doc_id", "source", "copy_no", "n_tokens", (F.col("cum") / F.col("weight")).alias("finish_time")), "queue")
    # cut the order at the budget: whole steps of time before the one in which the budget ends, and that step in order
    step = max(1.0, total / (bins * 4))
    steps = x.groupBy(F.floor(F.col("finish_time") / step).alias("step")).agg(F.sum("n_tokens").alias("s"))
    sofar = steps.withColumn("upto", F.sum("s").over(Window.orderBy("step")))  # over a few rows per bin, not over documents
    hit = sofar.filter(F.col("upto") > total).orderBy("step").first()
    if hit is None:
        return x.orderBy("finish_time", "source", "doc_id")
    at, used = hit["step"], hit["upto"] - hit["s"]
    in_step = F.floor(F.col("finish_time") / step)
    w = Window.orderBy("finish_time", "source", "doc_id", "copy_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = x.filter(in_step == at).withColumn("upto", F.sum("n_tokens").over(w)).filter(F.col("upto") + used <= total).drop("upto")
    return x.filter(in_step < at).unionByName(edge).orderBy("finish_time", "source", "doc_id")


def shares(mixed: DataFrame, targets: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(source, target_share, n_docs, n_tokens, actual_share, most_copies, bound), one row per listed source; bound: how far the share may be off the source's weight. What a source lacks at the cut is less than its next
    document, so it is at most the source's largest document (of tokens, or without these of the mix), or its weight's part of what all sources lack, over all tokens."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("copy_no").alias("most_copies"))
    most = (mixed if tokens is None else tokens).groupBy("source").agg(F.max("n_tokens").alias("_most"))
    j = targets.select("source", "target_share").join(got, "source", "left").join(most, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_copies", "_most"])
    whole = Window.partitionBy()  # over sources
    all_, lacking = F.sum("n_tokens").over(whole), F.sum("_most").over(whole)
    weight = F.when(F.col("_most") > 0, F.col("target_share") / F.sum(F.when(F.col("_most") > 0, F.col("target_share"))).over(whole)).otherwise(0.0)
    bound = F.when(all_ > 0, F.greatest(F.col("_most").cast("double"), weight * lacking) / all_).otherwise(0.0)
    return j.select("source", "target_share", "n_docs", "n_tokens", F.when(all_ > 0, F.col("n_tokens") / all_).otherwise(0.0).alias("actual_share"), "most_copies", bound.alias("bound"))
