"""Writing results: partitions per load, reset of a load, masking, evidence rows, content-named ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_load(df: DataFrame, path: str, by: str = "upload_batch_id") -> None:
    """Write loads, replacing those of the same id and leaving all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_load(spark: SparkSession, path: str, load: str, by: str = "upload_batch_id") -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={load}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load_batch(spark: SparkSession, path: str, load: str, by: str = "upload_batch_id") -> DataFrame:
    """The rows of one load, from its partition alone."""
    return spark.read.parquet(path).filter(F.col(by) == load)


def list_batches(spark: SparkSession, path: str, by: str = "upload_batch_id") -> DataFrame:
    """(load, line_count, documents) of what is stored."""
    return spark.read.parquet(path).groupBy(by).agg(F.count(F.lit(1)).alias("line_count"), F.count_distinct("document_id").alias("documents"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not there yet; of several with one key the first in order of all columns. Rows without a key are left out."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    rest = [c for c in df.columns if c != key]
    new = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*df.columns)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    new.write.mode("append").parquet(path)


class Log:
    """Append-only rows in a folder, with the state that they add up to: what was said last of each key, unless it was taken back. Serves for decisions, whitelists, feedback, audit trails and stored reports."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, df: DataFrame, deleted: bool = False) -> None:
        """df must have the columns of what is there. deleted: df's keys are taken back."""
        df.withColumn("_deleted", F.lit(deleted)).write.mode("append").parquet(self.path)

    def all(self, **where) -> DataFrame:
        """Every row, restricted to given values."""
        x = self.spark.read.parquet(self.path)
        for c, v in where.items():
            x = x.filter(F.col(c) == v)
        return x

    def current(self, key: str, at: list[str]) -> DataFrame:
        """The last row of each key, in order of `at` (which must tell rows of a key apart); none where that took the key back."""
        x = self.all().filter(F.col(key).isNotNull())
        rest = [c for c in x.columns if c != key]
        return x.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_e")).select(key, "_e.*").filter("not _deleted").drop("_deleted")


def approval_level(amount: Column, ladder: tuple[float, ...]) -> Column:
    """How many steps of the ladder an amount reaches; null for null."""
    return F.when(amount.isNotNull(), sum(((amount >= x).cast("int") for x in ladder), F.lit(0)))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones whenever it is asked: the first by a digest of key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def masked(c: Column, keep: int = 2) -> Column:
    """All but the first characters as stars; null stays null."""
    return F.concat(F.substring(c, 1, keep), F.repeat(F.lit("*"), F.greatest(F.length(c) - keep, F.lit(0))))


def hashed(c: Column, salt: str) -> Column:
    """A salted digest, the same for the same value; null stays null."""
    return F.when(c.isNotNull(), F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 16))


def content_id(prefix: str, *cols: str) -> Column:
    """An id made of the content: equal content gives equal ids. Nulls differ from empty texts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols)), 256), 1, 16))
