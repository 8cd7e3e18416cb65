"""Preparation of model inputs and drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import melted, order_bin, quantiles
from .skew import joined_by_key


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def frequency_encoded(df: DataFrame, column: str, name: str) -> DataFrame:
    """The share of rows that have the row's value; 0 for null."""
    n = df.count()
    g = df.filter(F.col(column).isNotNull()).groupBy(column).agg((F.count(F.lit(1)) / F.lit(float(max(1, n)))).alias(name))
    return joined_by_key(df, g, [column], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def rare_grouped(df: DataFrame, column: str, share: float = 0.01, other: str = "_OTHER_") -> DataFrame:
    """Categories below the share become one."""
    f = frequency_encoded(df, column, "_f")
    return f.withColumn(column, F.when(F.col("_f") >= share, F.col(column)).when(F.col(column).isNotNull(), F.lit(other))).drop("_f")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def scaling_policy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, policy, center, scale): standard where the column is nearly symmetric, else robust (median and interquartile range). One scan for the moments, one for the quantiles."""
    x = melted(df, columns, "double")
    g = x.groupBy("column_name").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.skewness("v").alias("sk"))
    g = g.join(quantiles(x, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["column_name"]), "column_name", "left")
    robust = F.abs("sk") > 2
    return g.select("column_name", F.when(robust, "robust").otherwise("standard").alias("policy"), F.when(robust, F.col("q2")).otherwise(F.col("m")).alias("center"), F.when(robust, F.col("q3") - F.col("q1")).otherwise(F.col("sd")).alias("scale"))


def psi_numeric(before: DataFrame, after: DataFrame, column: str, eps: float = 1e-4) -> DataFrame:
    """One row: the population stability index over 10 bins of the earlier load's z-scores (edges at -2, -1.5, ... 2)."""
    m = before.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    scale = m["s"] or 1.0

    def binned(df: DataFrame, name: str) -> DataFrame:
        z = (F.col(column) - F.lit(m["m"])) / F.lit(scale)
        b = F.greatest(F.lit(0), F.least(F.lit(9), F.floor(z * 2 + 5)))
        return df.filter(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias(name))

    return _psi(binned(before, "a"), binned(after, "b"), "bin", eps)


def psi_categorical(before: DataFrame, after: DataFrame, column: str, k: int = 10, eps: float = 1e-4) -> DataFrame:
    """The same over the earlier load's k most frequent values and all others as one."""
    top = [r[0] for r in before.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).collect()]
    v = F.when(F.col(column).isin(top), F.col(column)).otherwise("_OTHER_")
    side = lambda df, n: df.groupBy(v.alias("bin")).agg(F.count(F.lit(1)).alias(n))
    return _psi(side(before, "a"), side(after, "b"), "bin", eps)


def _psi(a: DataFrame, b: DataFrame, key: str, eps: float) -> DataFrame:
    j = a.join(b, key, "full").na.fill(0, ["a", "b"])
    w = Window.partitionBy()  # over bins
    pa, pb = (F.greatest(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(eps)) for c in "ab")
    return j.select(((pb - pa) * F.log(pb / pa)).alias("t")).agg(F.sum("t").alias("psi"))


def sequences(df: DataFrame, user: str, bins: Column, order: list[str], features: list[str], key: str = "row_id", length: int = 16, stride: int = 1, block: int = 4096) -> DataFrame:
    """(user, key, at, valid, steps): windows of `length` lines over each user's whole history, oldest first, one for every stride-th line from the first full window on. A user with fewer lines has
    one window, padded with zeros in front; `valid` counts the steps that are lines. key and at name the window's last line and its number among the user's.

    Lines are numbered by counts per user and bin and by their order within the bin; bins must be not null and never fall along the order. Windows run over blocks of equally many lines that begin with the last
    lines of the block before, so that what one task orders is bounded for a user who holds a third of all lines."""
    if not 1 <= length <= block:
        raise ValueError("length must be from 1 to block")
    row = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))
    x = df.filter(F.col(user).isNotNull()).select(*dict.fromkeys([user, key, *order]), bins.alias("_bin"), row.alias("_step"))
    w = Window.partitionBy(user)
    per = x.groupBy(user, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    per = per.select(user, "_bin", (F.sum("_c").over(w.orderBy("_bin")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    inner = Window.partitionBy(user, "_bin").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    x = x.join(per, [user, "_bin"]).withColumn("at", F.col("_before") + F.row_number().over(inner)).select(user, key, "at", "_n", "_step")
    own = F.floor((F.col("at") - 1) / block)
    carried = (F.col("at") - 1) % block > block - length
    x = x.withColumn("_block", F.explode(F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))))
    x = x.withColumn("steps", F.collect_list("_step").over(Window.partitionBy(user, "_block").orderBy("at").rowsBetween(1 - length, 0)))
    full = (F.col("at") >= length) & ((F.col("at") - length) % stride == 0)
    x = x.filter((F.col("_block") == own) & (full | ((F.col("_n") < length) & (F.col("at") == F.col("_n")))))
    pad = F.array_repeat(F.array(*(F.lit(0.0) for _ in features)), F.lit(length) - F.size("steps"))
    return x.select(user, key, "at", F.size("steps").alias("valid"), F.concat(pad, F.col("steps")).alias("steps"))


def bucket(c: Column, n: int, seed: int = 42) -> Column:
    """0..n - 1 by a digest of the value and the seed; nulls are one value."""
    digest = F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Marks each row train or test by a hash of its group, so that a group is never on both sides."""
    return df.withColumn("split", F.when(bucket(F.col(group), 10_000, seed) < int(share * 10_000), "test").otherwise("train"))


def temporal_holdout(df: DataFrame, at: str, group: str, cut) -> DataFrame:
    """Train before the cut, test from it on; test rows of groups seen in training are dropped."""
    tr, te = df.filter(F.col(at) < F.lit(cut)), df.filter(F.col(at) >= F.lit(cut))
    te = te.join(tr.select(group).distinct(), group, "left_anti")
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))


def null_flagged(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <c>_was_null and the column filled with its median (0 if it has no values)."""
    m = {r["column_name"]: r["m"] for r in quantiles(melted(df, columns, "double"), "v", {"m": 0.5}, ["column_name"]).collect()}  # a row per column
    return df.withColumns({f"{c}_was_null": F.col(c).isNull().cast("int") for c in columns} | {c: F.coalesce(F.col(c).cast("double"), F.lit(m.get(c) or 0.0)) for c in columns})


#: Powers that are tried.
LAMBDAS = [k / 10 for k in range(-20, 21)]


def yeo_johnson(c: Column, power: float) -> Column:
    up = F.log1p(c) if power == 0 else (F.pow(c + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-c) if power == 2 else -(F.pow(1 - c, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(c >= 0, up).otherwise(down)


def best_power(df: DataFrame, column: str) -> float | None:
    """The power under which the transformed values are most nearly normal (highest likelihood), of LAMBDAS; one pass. None without two different values."""
    v = F.col(column).cast("double")
    one = df.filter(v.isNotNull() & ~F.isnan(v)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.signum(v) * F.log1p(F.abs(v))).alias("s"), *(F.var_pop(yeo_johnson(v, p)).alias(f"v{k}") for k, p in enumerate(LAMBDAS))).first()
    like = {p: -one["n"] / 2 * math.log(one[f"v{k}"]) + (p - 1) * one["s"] for k, p in enumerate(LAMBDAS) if one["n"] and one[f"v{k}"] and one[f"v{k}"] > 0}
    return max(like, key=like.get) if like else None


def coverage(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """(column_name, coverage, kept): the share of rows with a value (blank is none), and whether it reaches what the column must have; one scan."""
    need = F.create_map(*(F.lit(x) for c, v in least.items() for x in (c, v)))
    g = melted(df, list(least), "string").groupBy("column_name").agg(F.avg((F.coalesce(F.trim("v"), F.lit("")) != "").cast("int")).alias("coverage"))
    return g.withColumn("kept", F.col("coverage") >= F.element_at(need, F.col("column_name")))


def stored_ecdf(train: DataFrame, df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the share of the training values that are at most the row's own. Training values are stored as counts; they and the rows' distinct values are put in order together, in two levels."""
    one = lambda x, w: x.select(F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(value).agg((F.count(F.lit(1)) * w).alias("_c"))
    c = one(train, 1).unionByName(one(df, 0)).groupBy(value).agg(F.sum("_c").alias("_c")).withColumn("_bin", order_bin(F.col(value)))
    per = c.groupBy("_bin").agg(F.sum("_c").alias("_b"))
    per = per.select("_bin", (F.sum("_b").over(Window.orderBy("_bin")) - F.col("_b")).alias("_before"), F.sum("_b").over(Window.partitionBy()).alias("_all"))  # over bins
    c = c.join(per, "_bin").withColumn(name, (F.col("_before") + F.sum("_c").over(Window.partitionBy("_bin").orderBy(value))) / F.col("_all"))
    x = df.withColumn(value, F.col(value).cast("double"))
    return joined_by_key(x, c.select(value, name), [value], "left")


def user_holdout(df: DataFrame, user: str, year: str, train: list[int], test: list[int]) -> DataFrame:
    """Rows of the training years, and of the test years those of users that the training years don't have."""
    tr = df.filter(F.col(year).isin(train))
    te = df.filter(F.col(year).isin(test)).join(tr.select(user).distinct(), user, "left_anti")
    return tr.withColumn("split", F.lit("train")).unionByName(te.select(*df.columns).withColumn("split", F.lit("test")))


def nonnegative_weights(df: DataFrame, columns: list[str], label: str, ridge: float = 1.0, rounds: int = 500) -> list[float]:
    """Weights of at least 0 by which the columns add up to the label with the least squared error (ridge-regularised). One pass for the products of columns, then coordinate descent on the driver over as many numbers as there are columns."""
    k = range(len(columns))
    s = df.agg(*(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i in k for j in k if j >= i), *(F.sum(F.col(columns[i]) * F.col(label)).alias(f"r{i}") for i in k)).first()
    g = [[(s[f"g{min(i, j)}_{max(i, j)}"] or 0.0) + (ridge if i == j else 0.0) for j in k] for i in k]
    w = [0.0] * len(columns)
    for _ in range(rounds):
        for i in k:
            w[i] = max(0.0, ((s[f"r{i}"] or 0.0) - sum(g[i][j] * w[j] for j in k if j != i)) / g[i][i])
    return w


def column_groups(metrics: DataFrame, kinds: dict[str, str], excluded: tuple[str, ...] = (), high: int = 50, missing: float = 0.95) -> DataFrame:
    """metrics (column_name, null_rate, distinct_count) -> (column_name, feature_group): excluded (by name, times, mostly missing), boolean, numeric, categorical_low (up to `high` values) or categorical_high. kinds: the type of each column."""
    kind = F.element_at(F.create_map(*(F.lit(x) for c, v in kinds.items() for x in (c, v))), F.col("column_name"))
    out = F.when(F.col("column_name").isin(*excluded, ""), "excluded").when(kind.startswith("datetime"), "excluded").when(F.col("null_rate") >= missing, "excluded")
    return metrics.select("column_name", out.when(kind == "bool", "boolean").when(kind.isin("int64", "float64"), "numeric").when(F.col("distinct_count") <= high, "categorical_low").otherwise("categorical_high").alias("feature_group"))
