"""Signals over time. Counts per day are aggregated first; windows run over the days of a series, never over ledger lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import blank, robust_z
from .skew import joined_by_key


def spine(counts: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One row for every day between a series' first and last, 0 where it has none."""
    edges = counts.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")) if keys else counts.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")).filter("_lo is not null")
    days = edges.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.join(counts, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def daily(gl: DataFrame, keys: list[str]) -> DataFrame:
    return gl.filter(F.col("posting_date").isNotNull()).groupBy(*keys, F.col("posting_date").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def burst(gl: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Robust z of each day's count against the trailing window of the days before it (at least burst_least of them); z - 1.5 within 0..30 is the score."""
    x = spine(daily(gl, keys), keys, "day", "n").withColumn("n", F.col("n").cast("double"))
    w = Window.partitionBy(*keys).orderBy("day")
    trail = w.rowsBetween(-s.burst_window, -1)
    x = x.withColumns({"seen": F.count("n").over(trail), "q": F.expr("percentile(n, array(0.25, 0.5, 0.75))").over(trail)})
    x = x.withColumn("med", F.when(F.col("seen") >= s.burst_least, F.col("q")[1])).withColumn("prev", F.lag("n").over(w)).withColumn("dev", F.abs(F.col("prev") - F.col("med")))
    mad = F.expr("percentile(dev, 0.5)").over(w.rowsBetween(1 - s.burst_window, 0))
    x = x.withColumn("mad", F.when(F.count("dev").over(w.rowsBetween(1 - s.burst_window, 0)) >= s.burst_least, mad))
    z = robust_z(F.col("n"), F.col("med"), F.coalesce("mad", F.lit(0.0)), F.col("q")[2] - F.col("q")[0])
    return x.filter("med is not null").select(*keys, "day", "n", F.greatest(F.lit(0.0), F.least(F.lit(30.0), z - 1.5)).alias("score")).filter("score > 0")


def rolling_outliers(gl: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Days whose count is above mean + 3 deviations of the rolling_days days before."""
    x = spine(daily(gl, keys), keys, "day", "n")
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-s.rolling_days, -1)
    x = x.withColumns({"seen": F.count("n").over(w), "m": F.avg("n").over(w), "sd": F.stddev_samp("n").over(w)})
    return x.filter((F.col("seen") >= s.rolling_days) & (F.col("n") > F.col("m") + 3 * F.col("sd"))).select(*keys, "day", "n")


def busy_ranges(gl: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Groups with the largest number of lines in any rolling_days days, where it reaches range_count."""
    d = daily(gl, keys).withColumn("no", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(*keys).orderBy("no").rangeBetween(1 - s.rolling_days, 0)
    return d.withColumn("r", F.sum("n").over(w)).groupBy(*keys).agg(F.max("r").alias("most")).filter(F.col("most") >= s.range_count)


def group_frequency(gl: DataFrame, key: str, s: Settings = DEFAULT) -> DataFrame:
    """Days of a group on which its rolling sum exceeds the median of the sums before by group_excess and group_ratio times."""
    d = daily(gl.filter(~blank(key)), [key])
    big = d.groupBy(key).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("a")).filter((F.col("t") >= s.group_least) & (F.col("a") >= s.group_days)).select(key)
    x = spine(d.join(big, key, "left_semi"), [key], "day", "n")
    w = Window.partitionBy(key).orderBy("day")
    x = x.withColumn("r", F.sum("n").over(w.rowsBetween(1 - s.rolling_days, 0)))
    x = x.withColumn("med", F.expr("percentile(r, 0.5)").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return x.filter((F.col("r") - F.col("med") >= s.group_excess) & (F.col("r") >= s.group_ratio * F.col("med"))).select(key, "day", "r", "med")


def amount_tail(gl: DataFrame) -> DataFrame:
    """Each line's place in the upper half of the positive amounts: 2 (ecdf - 0.5), 0 below."""
    from ..functions import base_amount, ecdf

    x = ecdf(gl.select("row_id", base_amount().alias("amount")), "amount", "place")
    return x.select("row_id", F.greatest(F.lit(0.0), F.col("place") - 0.5).alias("half")).select("row_id", (F.col("half") * 2).alias("tail"))


def pair_rarity(gl: DataFrame, a: str, b: str, least: int = 50) -> DataFrame:
    """Pairs of two columns with how often they occur and the share of lines whose pair is at least as frequent (1 / frequency as a zero-preserving ECDF)."""
    p = gl.filter(~blank(a) & ~blank(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("freq"))
    by = p.groupBy("freq").agg((F.sum("freq")).alias("lines"), F.count(F.lit(1)).alias("pairs"))
    w = Window.orderBy(F.desc("freq"))  # over distinct frequencies
    tot = by.agg(F.sum("lines").alias("t"), F.sum("pairs").alias("p")).first()
    if (tot["p"] or 0) < least:
        return p.limit(0).withColumn("rarity", F.lit(0.0))
    place = by.withColumn("rarity", F.sum("lines").over(w) / F.lit(float(tot["t"]))).select("freq", "rarity")
    return p.join(F.broadcast(place) if place.count() < 50_000 else place, "freq").select(a, b, "freq", "rarity")


def period_end_share(gl: DataFrame, days: int = 3) -> DataFrame:
    """Per month: lines on its last days, all lines, and their share."""
    x = gl.filter(F.col("posting_date").isNotNull())
    m = F.date_format("posting_date", "yyyy-MM").alias("month")
    return x.groupBy(m).agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.datediff(F.last_day("posting_date"), F.col("posting_date").cast("date")) < days, 1)).alias("at_end")).withColumn("share", F.col("at_end") / F.col("lines"))


def period_end_scores(gl: DataFrame, near: int = 3) -> DataFrame:
    """(row_id, raw): how near a line's day is to the end of its month (the last `near` days), times how far its day's count lies in the upper half of all days' counts (average rank of ties). Undated lines have 0."""
    d = daily(gl, [])
    w, all_ = Window.orderBy("n"), Window.partitionBy()  # over days
    d = d.withColumn("p", (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("n")) - 1) / 2) / F.count(F.lit(1)).over(all_))
    close = 1 - F.least(F.datediff(F.last_day("day"), F.col("day")), F.lit(near + 1)) / (near + 1)
    d = d.select("day", (close * F.greatest(F.lit(0.0), F.col("p") - 0.5) * 2).alias("raw"))
    x = gl.select("row_id", F.col("posting_date").cast("date").alias("day"))
    return joined_by_key(x, d, ["day"], "left").select("row_id", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def group_spikes(gl: DataFrame, key: str, s: Settings = DEFAULT, cap: float = 0.30) -> DataFrame:
    """(key, day, score, cold): days on which a group's rolling sum stands out from its sums before (robust z over all of them, less 1.5, within 0..30; excess and ratio at least as set). A group whose usual sum is 0 is cold, and
    its days score cap (1 - e^(-sum / 3)). Groups need a number of lines and of active days."""
    d = daily(gl.filter(~blank(key)), [key])
    big = d.groupBy(key).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("a")).filter((F.col("t") >= s.group_least) & (F.col("a") >= s.group_days)).select(key)
    x = spine(d.join(big, key, "left_semi"), [key], "day", "n")
    w, least = Window.partitionBy(key).orderBy("day"), max(2, s.rolling_days // 2)
    now, before = w.rowsBetween(1 - s.rolling_days, 0), w.rowsBetween(-s.rolling_days, -1)
    x = x.withColumns({"v": F.when(F.count("n").over(now) >= least, F.sum("n").over(now)).cast("double"), "b": F.when(F.count("n").over(before) >= least, F.sum("n").over(before)).cast("double")})
    # over a group's days
    g = x.groupBy(key).agg(F.count("b").alias("k"), F.expr("percentile(b, array(0.25, 0.5, 0.75))").alias("q")).filter("k >= 2")
    m = x.join(g, key).groupBy(key).agg(F.expr("percentile(abs(b - q[1]), 0.5)").alias("mad"))
    y = x.join(g, key).join(m, key).filter("v > 0")
    med = F.col("q")[1]
    z = F.greatest(F.lit(0.0), F.least(F.lit(30.0), robust_z(F.col("v"), med, F.col("mad"), F.col("q")[2] - F.col("q")[0]) - 1.5))
    hot = (F.col("v") - med >= s.group_excess) & (F.col("v") / F.greatest(med, F.lit(1.0)) >= s.group_ratio)
    score = F.when(med == 0, F.lit(cap) * (1 - F.exp(-F.col("v") / 3))).when(hot, z).otherwise(0.0)
    return y.select(key, "day", score.alias("score"), (med == 0).alias("cold")).filter("score > 0")


def context_flags(gl: DataFrame, s: Settings = DEFAULT, timed: bool | None = None) -> DataFrame:
    """(row_id, late, manual, round): 0.5 where a line is posted out of hours or at a weekend, by hand, or with a round amount."""
    from ..functions import base_amount
    from . import features as X

    x = X.pattern_features(X.time_features(gl, s, timed), s)
    half = lambda c: F.when(F.coalesce(c, F.lit(False)), 0.5).otherwise(0.0)
    return x.select("row_id", half(F.col("is_after_hours") | F.col("is_weekend")).alias("late"), half(F.col("is_manual_je")).alias("manual"), half(X.is_round(base_amount(), s)).alias("round"))


def row_rarity(gl: DataFrame, a: str, b: str, name: str, least: int = 50) -> DataFrame:
    """(row_id, name): the rarity of each line's pair; 0 without one, or if there are too few pairs."""
    p = pair_rarity(gl, a, b, least).select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("rarity").alias(name))
    x = gl.select("row_id", F.col(a).alias("_a"), F.col(b).alias("_b"))
    return joined_by_key(x, p, ["_a", "_b"], "left").select("row_id", F.coalesce(name, F.lit(0.0)).alias(name))


def composite(x: DataFrame, rarities: list[str], least: int = 3, tail: float = 0.90, far: float = 0.95, most: float = 0.80, end_least: float = 0.05, strong_least: float = 0.30) -> DataFrame:
    """x (strong, period_end, late, manual, round, rarities...) with composite: where nothing strong speaks for a line, several weak signs together do: at least `least` of contexts and high rarities, one context among them."""
    some = lambda c, v: (F.col(c) >= v).cast("int")
    ctx = some("period_end", end_least) + sum(((F.col(c) > 0).cast("int") for c in ("late", "manual", "round")), F.lit(0))
    high = lambda v: ctx + sum((some(c, v) for c in rarities), F.lit(0))
    top = F.greatest(*(F.col(c) for c in rarities))
    both = (high(far) >= least) & (ctx >= 1) & (top >= far)
    part = (high(tail) >= least) & (ctx >= 1) & (top >= tail)
    return x.withColumn("composite", F.when(F.col("strong") >= strong_least, 0.0).when(both, F.least(top, F.lit(most))).when(part, F.least(top * 0.7, F.lit(most))).otherwise(0.0))
