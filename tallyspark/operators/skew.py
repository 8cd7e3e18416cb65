"""Per-key results where a few keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch (one pass, map-side, a few kB per task), and counted exactly
afterwards. Rows of heavy keys meet the list of heavy keys by a broadcast join (its size is bounded by the sketch:
at most 1 / threshold keys) and are aggregated under a salt first; all other rows take the ordinary shuffle; the two
results are united.

Defined results: null keys form no group (counted apart by the callers that want them); an empty table gives an empty
result; ties need no rule as every key is kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_small, written

#: Items that the sketch tracks. Its counts are too low by at most about 4 / ITEMS of the rows, far under the thresholds used.
ITEMS = 4096


def heavy_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys that may hold at least `share` of the rows of df: all that do, and perhaps a few slightly below. At most 2 / share values reach the driver."""
    k = max(1, int(2 / share))
    got = df.select(F.col(f"`{key}`").alias("k")).filter("k is not null").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {min(k, ITEMS)}, {ITEMS})").alias("top")).first()
    floor = got["n"] * max(0.0, share - 4 / ITEMS)
    return [x["item"] for x in got["top"] if x["count"] >= floor] if got["n"] else []


def totals_by_key(df: DataFrame, key: str, amounts: Sequence[str], share: float = 0.01, salts: int = 64) -> DataFrame:
    """(key_value, n_rows, sum_<amount>..., is_heavy) for each non-null key."""
    spark = df.sparkSession
    heavy = heavy_keys(df, key, share)
    rows = df.select(F.col(f"`{key}`").alias("key_value"), *(F.col(f"`{a}`").cast("double").alias(f"a{i}") for i, a in enumerate(amounts))).filter("key_value is not null")
    aggs = [F.count(F.lit(1)).alias("n_rows"), *(F.sum(f"a{i}").alias(f"a{i}") for i in range(len(amounts)))]
    again = [F.sum("n_rows").alias("n_rows"), *(F.sum(f"a{i}").alias(f"a{i}") for i in range(len(amounts)))]
    names = ["key_value", "n_rows", *(F.col(f"a{i}").alias(f"sum_{a}") for i, a in enumerate(amounts))]
    if not heavy:
        return rows.groupBy("key_value").agg(*aggs).select(*names, F.lit(False).alias("is_heavy"))
    keys = F.broadcast(spark.createDataFrame([(h,) for h in heavy], rows.select("key_value").schema))
    salt = F.spark_partition_id() % salts
    hot = rows.join(keys, "key_value").withColumn("salt", salt).groupBy("key_value", "salt").agg(*aggs).groupBy("key_value").agg(*again)
    rest = rows.join(keys, "key_value", "left_anti").groupBy("key_value").agg(*aggs)
    return hot.select(*names, F.lit(True).alias("is_heavy")).unionByName(rest.select(*names, F.lit(False).alias("is_heavy")))


def dominant_keys(df: DataFrame, keys: Sequence[str], share: float = 0.05) -> DataFrame:
    """(field_name, key_value): non-null values that hold at least `share` of all rows of df, exactly."""
    total = df.count()
    out = None
    for k in keys:
        t = totals_by_key(df, k, [], share).filter(F.col("n_rows") >= F.lit(share) * total).select(F.lit(k).alias("field_name"), F.col("key_value").cast("string").alias("key_value"))
        out = t if out is None else out.unionByName(t)
    return out


def joined_by_key(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", by: str | None = None, share: float = 0.01) -> DataFrame:
    """df joined (inner, left, left_semi or left_anti) with a table that has few rows per key, whatever share of df's rows one key holds.

    A table shown to be small is sent to every executor. Beyond that, keys that hold much of df (in the column `by`, the first of `on` unless given) meet their rows of the table by
    broadcast, and all other rows by the ordinary shuffle; the two are united."""
    on, table = list(on), written(table, "lookup")
    if is_small(table):
        return df.join(F.broadcast(table), on, how)
    by = by or on[0]
    heavy = heavy_keys(df, by, share)
    if not heavy:
        return df.join(table, on, how)
    hot = written(table.filter(F.col(f"`{by}`").isin(heavy)), "heavy")
    is_hot = F.coalesce(F.col(f"`{by}`").isin(heavy), F.lit(False))
    rest = df.filter(~is_hot).join(table, on, how)
    return df.filter(is_hot).join(F.broadcast(hot) if is_small(hot) else hot, on, how).unionByName(rest)
