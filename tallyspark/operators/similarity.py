"""Vectors: cosine to a group's centre, and what lies far from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantiles
from .skew import joined_by_key


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, vec: str, group: str) -> DataFrame:
    """(group, centre). Means are taken per dimension, so a large group is summed in parts."""
    x = df.filter(F.col(group).isNotNull()).select(group, F.posexplode(vec).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return x.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # one element per dimension


def far_from_centre(df: DataFrame, id_col: str, vec: str, group: str, q: float = 0.95) -> DataFrame:
    """(id, group, distance): members whose cosine distance to their group's centre is above the group's q-quantile. Null vectors and groups take no part."""
    v = df.filter(F.col(vec).isNotNull() & F.col(group).isNotNull()).withColumn("_v", F.col(vec).cast("array<double>"))
    d = joined_by_key(v, centroids(v, "_v", group), [group]).select(id_col, group, (1 - cosine(F.col("_v"), F.col("centre"))).alias("distance"))
    edge = quantiles(d, "distance", {"edge": q}, [group])
    return joined_by_key(d, edge, [group]).filter(F.col("distance") > F.col("edge")).select(id_col, group, "distance")
