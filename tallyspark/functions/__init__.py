"""Column expressions that operators are built of. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("double"), F.lit(0.0))


def base_amount() -> Column:
    """The larger of debit and credit; what isn't a number counts as 0."""
    return F.greatest(zero("debit_amount"), zero("credit_amount"))


def plain(c: str | Column) -> Column:
    """Trimmed and lower-cased; null for null."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c.cast("string")) == "")


def robust_z(x: Column, med: Column, mad: Column, iqr: Column) -> Column:
    """(x - median) over the MAD, else over the interquartile range, else over a Poisson spread of at least 1, else x itself within 0..10."""
    poisson = (x - med) / F.greatest(F.sqrt(med), F.lit(1.0))
    return F.when(mad > 0, 0.6745 * (x - med) / mad).when(iqr > 0, (x - med) / (iqr / 1.349)).when(med > 0, poisson).otherwise(F.greatest(F.lit(0.0), F.least(x, F.lit(10.0))))


def to_number(c: Column) -> Column:
    """Amounts as people write them: currency signs, thousands separators, parentheses or a trailing minus for negative; null if it is none."""
    t = F.regexp_replace(F.trim(c.cast("string")), "[​﻿₩$€£¥,\\s]", "")
    t = F.regexp_replace(t, r"^\((.*)\)\z", r"-$1")
    t = F.regexp_replace(t, r"^([0-9.]+)-\z", r"-$1")
    return F.when(~F.lower(t).isin("", "-", "nan", "null", "none", "n/a"), t.try_cast("double"))


def to_date(c: Column) -> Column:
    """Dates in the usual formats, and day numbers of spreadsheets."""
    s = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "dd.MM.yyyy", "MM/dd/yyyy")]
    serial = F.when(s.rlike(r"^[0-9]{5}(\.[0-9]+)?\z"), F.timestamp_seconds((s.try_cast("double") - 25569) * 86400))
    return F.coalesce(*tries, serial)


def to_flag(c: Column) -> Column:
    """Truth values as people write them; null if it is none."""
    s = plain(c.cast("string"))
    return F.when(s.isin("true", "t", "yes", "y", "1", "1.0", "x"), True).when(s.isin("false", "f", "no", "n", "0", "0.0", ""), False)


#: Order-keeping bins of a number, per unit of log(1 + |x|).
BINS = 1024


def order_bin(c: Column) -> Column:
    """A coarse bin that grows with the value; numbers of any size fall into some ten thousand bins."""
    return F.floor(F.signum(c) * F.log1p(F.abs(c)) * BINS)


def running_count(df: DataFrame, value: str, name: str, keys: list[str] | None = None, descending: bool = False) -> DataFrame:
    """(keys, value, _c, _all, name): for each distinct value that is not null, how often it occurs, how many rows there are, and how many are at most (descending: at least) as large.

    Occurrences are summed per value, then per bin; running sums go over bins and, separately, within each bin, so neither rows nor distinct values are ever in one task."""
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_bin", order_bin(F.col(value).cast("double")))
    way = F.desc if descending else F.asc
    per = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_b"))
    w = Window.partitionBy(*keys)
    per = per.withColumn("_before", F.sum("_b").over(w.orderBy(way("_bin"))) - F.col("_b")).withColumn("_all", F.sum("_b").over(w)).drop("_b")
    inner = Window.partitionBy(*keys, "_bin").orderBy(way(value))
    return counts.join(per, [*keys, "_bin"]).withColumn(name, F.col("_before") + F.sum("_c").over(inner)).drop("_bin", "_before")


def ecdf(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """The share of rows (of each group) whose value is at most the row's own, zeros and nulls kept at 0 and left out of the base."""
    from ..operators.skew import joined_by_key

    keys = keys or []
    pos = F.coalesce((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")), F.lit(False))
    some = df.filter(pos)
    cum = running_count(some.select(*keys, value), value, "_r", keys).select(*keys, value, (F.col("_r") / F.col("_all")).alias(name))
    # rows at 0 and without a value, usually most, take no part in the join
    return joined_by_key(some, cum, [*keys, value], by=value).select(*df.columns, name).unionByName(df.filter(~pos).withColumn(name, F.lit(0.0)))


def quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """(keys, one column per entry of qs): exact quantiles with linear interpolation between neighbours, over the values that are not null or NaN. From counts of distinct values (running_count), so no
    task holds all values of a group."""
    keys = keys or []
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    r = running_count(x, "_v", "_r", keys)
    at = lambda pos: F.max(F.when((pos >= F.col("_r") - F.col("_c")) & (pos < F.col("_r")), F.col("_v")))
    place = {n: F.lit(q) * (F.col("_all") - 1) for n, q in qs.items()}
    g = [f(p).alias(f"{side}_{n}") for n, p in place.items() for side, f in (("_lo", lambda p: at(F.floor(p))), ("_hi", lambda p: at(F.ceil(p))), ("_f", lambda p: F.max(p - F.floor(p))))]
    r = r.groupBy(*keys).agg(*g) if keys else r.agg(*g)
    return r.select(*keys, *((F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in qs))


def melted(df: DataFrame, columns: list[str], cast: str, ids: list[str] | None = None) -> DataFrame:
    """(ids, column_name, v): a row for each of the columns, in one scan."""
    return df.select(*(ids or []), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("v")) for c in columns))).alias("_x")).select(*(ids or []), "_x.*")
