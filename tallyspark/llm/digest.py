"""Percentiles from merging centroid digests.

A digest clusters sorted values so that a cluster holds few values near the ends and more in the middle (the arcsine size function), in one
vectorised step; digests are merged by clustering their centroids again. Every task makes one digest per group
before the shuffle, so a group of any size moves a few hundred centroids per task, and digests of days or loads may be
stored and added up later. A second pass counts the rows around each estimate: it certifies the rank error, and, asked for
exact values, reads the value at the position out of the bracket that the digest gives (widened until the count proves that it
holds the position).

Defined results: percentile p is the value at position ceil(n p / 100), ascending; null and NaN values and null groups take no part; groups
without values give no rows; ties need no rule; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import joined_by_key
from ..session import small_or_shuffled, written

#: Clusters per digest, at most about this many.
COMPRESSION = 400
#: Values or centroids that a task gathers for a group before it clusters them, and in all before it passes digests on.
BUFFER, HELD = 8_192, 2_000_000


def cluster(means: np.ndarray, weights: np.ndarray, compression: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of values (or centroids) in any order."""
    order = np.argsort(means, kind="stable")
    m, w = means[order], weights[order]
    n = w.sum()
    middle = (np.cumsum(w) - w / 2) / n
    k = np.floor(compression * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    total = np.add.reduceat(w, first)
    return np.add.reduceat(m * w, first) / total, total


def value_at(means: Sequence[float], weights: Sequence[float], low: float, high: float, position: float) -> float:
    """The estimated value at a position, 1..n."""
    if position <= 1:
        return float(low)
    w = np.asarray(weights)
    if position >= w.sum():
        return float(high)
    at = np.r_[1.0, np.cumsum(w) - w / 2 + 0.5, w.sum()]
    return float(np.interp(position, at, np.r_[low, means, high]))


def _schema(group_col: str, t: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField(group_col, t), T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
    ])


class _Building:
    """One group's centroids and the values not yet clustered."""

    __slots__ = ("high", "low", "m", "n", "w")

    def __init__(self):
        self.m, self.w, self.n, self.low, self.high = [], [], 0, np.inf, -np.inf

    def add(self, m: np.ndarray, w: np.ndarray, low: float, high: float) -> int:
        """The growth in numbers held."""
        had = self.n
        self.m.append(m)
        self.w.append(w)
        self.n += len(m)
        self.low, self.high = min(self.low, low), max(self.high, high)
        if self.n > BUFFER:
            self.close()
        return self.n - had

    def close(self) -> None:
        m, w = cluster(np.concatenate(self.m), np.concatenate(self.w))
        self.m, self.w, self.n = [m], [w], len(m)


def _batch(closed: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    for _, b in closed:
        b.close()
    lists = lambda get: pa.array([get(b) for _, b in closed], pa.list_(pa.float64()))
    cols = [pa.array([g for g, _ in closed], key), lists(lambda b: b.m[0]), lists(lambda b: b.w[0]), pa.array([b.low for _, b in closed], pa.float64()), pa.array([b.high for _, b in closed], pa.float64())]
    return pa.RecordBatch.from_arrays(cols, names=names)


def digests(df: DataFrame, group_col: str, value: Column) -> DataFrame:
    """One digest per group: (group_col, means, weights, low, high)."""
    schema = _schema(group_col, df.schema[group_col].dataType)
    names = schema.names

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, by, key = 0, {}, None
        for b in batches:
            key = b.schema.field(0).type
            codes = b.column(0).dictionary_encode()
            c, v = codes.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            groups = codes.dictionary.to_pylist()
            order = np.argsort(c, kind="stable")
            ends = np.searchsorted(c[order], np.arange(len(groups) + 1))
            for k, g in enumerate(groups):
                x = v[order[ends[k] : ends[k + 1]]]
                if g not in by:
                    by[g] = _Building()
                held += by[g].add(x, np.ones(len(x)), x.min(), x.max())
            if held > HELD:
                yield _batch(list(by.items()), names, key)
                held, by = 0, {}
        if by:
            yield _batch(list(by.items()), names, key)

    rows = df.select(F.col(group_col), value.cast("double").alias("v")).filter(F.col(group_col).isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    return merge(rows.mapInArrow(build, schema), group_col)


def merge(parts: DataFrame, group_col: str) -> DataFrame:
    """Add up digests of the same groups, from tasks, days or loads. The rows of a group stream past; one group is held at a time."""
    schema = parts.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, key, closed = None, None, None, []
        for b in batches:
            key = b.schema.field(0).type
            for g, m, w, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or g != group:
                    if now is not None:
                        now.close()
                        closed.append((group, now))
                    group, now = g, _Building()
                now.add(np.asarray(m), np.asarray(w), low, high)
            if len(closed) >= 500:
                yield _batch(closed, names, key)
                closed = []
        if now is not None:
            yield _batch([*closed, (group, now)], names, key)

    return parts.repartition(F.col(group_col)).sortWithinPartitions(group_col).mapInArrow(run, schema)


def brackets(d: DataFrame, group_col: str, percentiles: Sequence[float], widen: float = 1.0) -> DataFrame:
    """(group_col, percentile, n, position, estimate, lo, hi): hi - lo spans a few clusters around the estimate, `widen` times as many on each side."""
    schema = T.StructType([
        T.StructField(group_col, d.schema[group_col].dataType), T.StructField("percentile", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("position", T.LongType()),
        T.StructField("estimate", T.DoubleType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
    ])
    ps = [float(p) for p in percentiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema.names]
            for g, m, w, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = round(sum(w))
                for p in ps:
                    at = min(n, max(1, -int(-(n * p) // 100)))
                    q = at / n
                    slack = widen * (2 * np.pi * np.sqrt(q * (1 - q)) * n / COMPRESSION + 2)
                    lo, hi = value_at(m, w, low, high, at - slack), value_at(m, w, low, high, at + slack)
                    for to, x in zip(out, (g, p, n, at, value_at(m, w, low, high, at), lo, hi), strict=True):
                        to.append(x)
            types = [b.schema.field(0).type, pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=schema.names)

    return d.mapInArrow(run, schema)


def _ranked(df: DataFrame, group_col: str, value: Column, br: DataFrame) -> DataFrame:
    """One row per group and percentile: the value at the position if it lies within the bracket, and the ranks that the estimate covers.

    Rows are counted per value first. The counts are put in order by ranges of (group, percentile, value), each in a part of its own; sums of parts tell in which part the
    position lies, and only that part's values are summed one by one, so no task holds all of a group's bracket."""
    key = [group_col, "percentile"]
    rows = df.select(F.col(group_col), value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    per = br.groupBy(group_col).agg(F.collect_list(F.struct("percentile", "lo", "hi")).alias("b"))  # as many as there are percentiles
    near = joined_by_key(rows, per, [group_col]).select(group_col, "v", F.explode(F.filter("b", lambda x: F.col("v") <= x["hi"])).alias("x"))
    # rows below the bracket fall into one class, those within keep their value; both are counted before the shuffle
    counts = near.groupBy(group_col, F.col("x.percentile").alias("percentile"), F.when(F.col("v") >= F.col("x.lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = F.col("v").asc_nulls_first()
    counts = written(counts.repartitionByRange(F.col(group_col), F.col("percentile"), order).withColumn("part", F.spark_partition_id()), "counts")
    marked = joined_by_key(counts, br.select(*key, "position", "n", "estimate"), key)
    upto = lambda cond: F.sum(F.when(F.col("v").isNull() | cond, F.col("c")).otherwise(0))
    ranks = marked.groupBy(*key, "position", "n", "estimate").agg(upto(F.col("v") < F.col("estimate")).alias("rank_lo"), upto(F.col("v") <= F.col("estimate")).alias("rank_hi"))
    parts = marked.groupBy(*key, "part", "position").agg(F.sum("c").alias("pc"))
    parts = parts.withColumn("before", F.sum("pc").over(Window.partitionBy(*key).orderBy("part")) - F.col("pc"))  # over parts
    hit = parts.filter((F.col("before") < F.col("position")) & (F.col("before") + F.col("pc") >= F.col("position"))).select(*key, "part", "before", "position")
    w = Window.partitionBy(*key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.join(small_or_shuffled(hit), [*key, "part"]).withColumn("r", F.col("before") + F.sum("c").over(w)).filter(F.col("r") >= F.col("position"))
    return ranks.join(at.groupBy(*key).agg(F.min_by("v", "r").alias("value")), key, "left")


def exact_percentiles(df: DataFrame, group_col: str, value: Column, percentiles: Sequence[float], d: DataFrame | None = None) -> DataFrame:
    """(group_col, percentile, n, position, estimate, value, rank_error): value is exact, rank_error is how many positions the digest's estimate is
    off (0 if the estimate's own rows cover the position), proven by the counting pass."""
    d = written(digests(df, group_col, value) if d is None else d, "digests")
    todo, widen, done = d, 1.0, None
    for last in (False, False, True):
        br = written(brackets(todo, group_col, percentiles, widen), "brackets")
        if last:  # everything is within
            br = br.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))})
        r = written(_ranked(df, group_col, value, br), "ranked")
        ok = r.filter(F.col("value").isNotNull())
        done = ok if done is None else done.unionByName(ok)
        failed = r.filter(F.col("value").isNull()).select(group_col, "percentile")
        if last or failed.isEmpty():
            break
        todo = todo.join(failed.select(group_col).distinct(), group_col, "left_semi")
        done = done.join(failed.select(group_col).distinct(), group_col, "left_anti")  # the group comes again as a whole
        widen *= 8
    lo, hi = F.col("rank_lo"), F.col("rank_hi")
    error = F.when(F.col("position") > hi, F.col("position") - hi).when(F.col("position") <= lo, lo + 1 - F.col("position")).otherwise(0)
    return done.select(group_col, "percentile", "n", "position", "estimate", "value", error.cast("long").alias("rank_error"))


def heavy_tails(df: DataFrame, group_col: str, value: Column, least: int = 20, times: float = 50.0) -> DataFrame:
    """Groups of at least `least` values whose 99th percentile of the absolute value is more than `times` their median."""
    e = exact_percentiles(df, group_col, F.abs(value), (50, 99))
    g = e.filter(F.col("n") >= least).groupBy(group_col).agg(F.max(F.when(F.col("percentile") == 50, F.col("value"))).alias("mid"), F.max(F.when(F.col("percentile") == 99, F.col("value"))).alias("far"))
    return g.filter(F.col("far") > times * F.col("mid")).select(group_col)
