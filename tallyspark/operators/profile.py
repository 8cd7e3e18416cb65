"""Column profiles from persistent value-count tables.

Every column of a table is kept as counts of (load, column, value). A load is added, or taken back, by appending a
signed delta; null rate, distinct count, range, pattern violations, entropy, medians and domain changes are all derived
from the maintained counts, exactly. sync() brings a store up to date with a table: only loads that are new or have changed since are
counted, and what was counted of those that changed or went is taken back.

The counting reads the table once for each kind of value (strings, doubles, whole numbers and times), each pass only its columns, and
aggregates before the shuffle, which carries counts of distinct values, never rows.

Defined results: a null value is counted as a value of its own and takes part in null rates only; NaN is an ordinary
value; an empty table has no counts; columns of any clashing names are safe as the counts have fixed names of
their own (load_id, column_name, s, d, i, n); repeated rows count as often as they occur.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["load_id", "column_name", "s", "d", "i"]
COUNT_SCHEMA = T.StructType([
    T.StructField("load_id", T.StringType()), T.StructField("column_name", T.StringType()), T.StructField("s", T.StringType()),
    T.StructField("d", T.DoubleType()), T.StructField("i", T.LongType()), T.StructField("n", T.LongType()),
])
#: Coarse, order-keeping bins of a positive double: BINS per unit of its natural logarithm.
BINS = 32


def dtype_name(t: T.DataType) -> str:
    """The catalogue's name of a Spark type."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float64"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[us]"
    return "bool" if isinstance(t, T.BooleanType) else "object"


def _kind(t: T.DataType) -> str:
    """Which of the three a value is kept as: string, double or bigint."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "d"
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
    return "i" if isinstance(t, whole) else "s"


def _encoded(c: Column, t: T.DataType) -> tuple[Column, Column, Column]:
    """The value as (string, double, bigint); exactly one is set unless the value is null."""
    s, d, i = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("bigint")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return s, c.cast("double"), i
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return s, d, c.cast("bigint")
    if isinstance(t, T.TimestampType):
        return s, d, F.unix_micros(c)
    if isinstance(t, T.TimestampNTZType):
        return s, d, F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)
    if isinstance(t, T.DateType):
        return s, d, F.unix_date(c).cast("bigint")
    if isinstance(t, T.StringType):
        return c, d, i
    return (F.base64(c) if isinstance(t, T.BinaryType) else c.cast("string")), d, i


def value_counts(df: DataFrame, load_col: str, columns: list[str] | None = None) -> DataFrame:
    """Counts of each (load, column, value) as COUNT_SCHEMA. Rows with a null load belong to the load null."""
    columns = [c for c in df.columns if c != load_col] if columns is None else columns
    load = F.col(f"`{load_col}`").cast("string").alias("load_id")
    kinds: dict[str, list] = {"s": [], "d": [], "i": []}
    for c in columns:
        values = dict(zip("sdi", _encoded(F.col(f"`{c}`"), df.schema[c].dataType), strict=True))
        kinds[_kind(df.schema[c].dataType)].append((c, values))
    parts = []
    for k, cols in kinds.items():
        if not cols:
            continue
        names = F.array(*(F.lit(c) for c, _ in cols))
        x = df.select(load, F.posexplode(F.array(*(v[k] for _, v in cols))).alias("c", "v"))
        g = x.groupBy("load_id", "c", "v").agg(F.count(F.lit(1)).alias("n"))
        one = {f.name: F.col("v") if f.name == k else F.lit(None).cast(f.dataType) for f in COUNT_SCHEMA if f.name in "sdi"}
        parts.append(g.select("load_id", F.element_at(names, F.col("c") + 1).alias("column_name"), *(e.alias(n) for n, e in one.items()), "n"))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], COUNT_SCHEMA)


def load_marks(df: DataFrame, load_col: str, columns: list[str]) -> DataFrame:
    """(load_id, mark) of each load: its number of rows and two sums over hashes of them, in any order."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    g = df.select(F.col(f"`{load_col}`").cast("string").alias("load_id"), h.alias("h")).groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))).alias("a"), F.sum(F.shiftrightunsigned("h", 33)).alias("b"))
    return g.select("load_id", F.concat_ws("-", "n", "a", "b").alias("mark"))


class ValueCountStore:
    """Value-count tables kept in a folder: an append-only log of signed deltas, one per call of apply(). A delta counts once its entries in the log are written, which comes last; what an interrupted
    call left behind is not read."""

    LOG = "delta string, load_id string, sign int, mark string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda d: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{d}/_SUCCESS"))
        return sorted(n for x in fs.listStatus(p) if done(n := x.getPath().getName())) if fs.exists(p) else []

    @property
    def deltas(self) -> int:
        return len(self._names())

    def apply(self, counts: DataFrame, sign: int = 1, marks: DataFrame | None = None) -> None:
        """Add (sign 1) or take back (sign -1) the counts of one or more loads. Costs as much as the delta, however large the store. marks (load_id, mark): what sync() compares."""
        name = f"{self.deltas + 1:06d}-{uuid.uuid4().hex[:8]}"
        counts.withColumn("n", F.col("n") * F.lit(sign)).write.mode("errorifexists").parquet(f"{self.path}/counts/{name}")
        if marks is None:
            marks = self.spark.read.schema(COUNT_SCHEMA).parquet(f"{self.path}/counts/{name}").select("load_id", F.lit(None).cast("string").alias("mark")).distinct()
        marks.select(F.lit(name).alias("delta"), "load_id", F.lit(sign).alias("sign"), "mark").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/log/{name}")

    def loads(self) -> DataFrame:
        """(load_id, mark) of the loads that the store holds."""
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], "load_id string, mark string")
        log = self.spark.read.schema(self.LOG).parquet(*(f"{self.path}/log/{n}" for n in names))
        # the last entry of a load says whether it is there
        g = log.groupBy("load_id").agg(F.sum("sign").alias("held"), F.max_by("mark", F.struct("delta", "sign")).alias("mark"))
        return g.filter("held > 0").select("load_id", "mark")

    def sync(self, df: DataFrame, load_col: str, columns: list[str]) -> "ValueCountStore":
        """Make the store agree with the table, load by load."""
        now = load_marks(df, load_col, columns)
        j = now.alias("t").join(self.loads().alias("s"), F.col("t.load_id").eqNullSafe(F.col("s.load_id")), "full")
        same = F.coalesce(F.col("t.mark") == F.col("s.mark"), F.lit(False))
        diff = j.filter(~same).select(F.col("t.load_id").alias("t_load"), F.col("t.mark").alias("mark"), F.col("s.mark").alias("old"), F.col("s.load_id").alias("s_load"))
        rows = diff.collect()  # a row per load that is new, changed or gone
        schema = "load_id string, mark string"
        gone = self.spark.createDataFrame([(r["s_load"], r["old"]) for r in rows if r["old"] is not None], schema)
        new = self.spark.createDataFrame([(r["t_load"], r["mark"]) for r in rows if r["mark"] is not None], schema)
        of = lambda x, load, loads: x.join(F.broadcast(loads.select(F.col("load_id").alias("_l"))), F.col(f"`{load}`").cast("string").eqNullSafe(F.col("_l")), "left_semi")
        if any(r["old"] is not None for r in rows):
            self.apply(of(self.current(), "load_id", gone), -1, gone)
        if any(r["mark"] is not None for r in rows):
            self.apply(value_counts(of(df, load_col, new) if self.deltas else df, load_col, columns), 1, new)
        return self

    def current(self) -> DataFrame:
        """The counts after all deltas. One delta alone holds each key once, so it is read as it is; values whose counts have come to 0 vanish."""
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], COUNT_SCHEMA)
        x = self.spark.read.schema(COUNT_SCHEMA).parquet(*(f"{self.path}/counts/{n}" for n in names))
        return (x if len(names) == 1 else x.groupBy(*KEYS).agg(F.sum("n").alias("n"))).filter("n <> 0")

    def compact(self) -> "ValueCountStore":
        """Merge the log into one delta, in a new folder beside this one."""
        to = ValueCountStore(self.spark, f"{self.path}-compact{self.deltas}")
        to.apply(self.current(), 1, self.loads())
        return to


def metrics(counts: DataFrame) -> DataFrame:
    """One row per load and column: row_count, nulls, null_rate, distinct_count, min_num, max_num, entropy (bits, over the non-null values)."""
    some = F.coalesce("s", F.col("d").cast("string"), F.col("i").cast("string")).isNotNull()
    num = F.coalesce("d", F.col("i").cast("double"))
    nn = F.when(some, F.col("n")).otherwise(0)
    g = counts.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("nulls"),
        F.count(F.when(some, 1)).alias("distinct_count"),
        F.min(num).alias("min_num"), F.max(num).alias("max_num"),
        F.sum(nn * F.log2(F.greatest(nn, F.lit(1)).cast("double"))).alias("_nlogn"),
    )
    filled = F.col("row_count") - F.col("nulls")
    return g.select(
        "load_id", "column_name", "row_count", "nulls", (F.col("nulls") / F.col("row_count")).alias("null_rate"), "distinct_count", "min_num", "max_num",
        F.when(filled > 0, F.log2(filled.cast("double")) - F.col("_nlogn") / filled).alias("entropy"),
    )


def medians(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of the absolute non-zero values (position ceil(n/2)) per load and double column. Counts are first summed in coarse bins; only the bin that holds the
    position is put in order, so no task sees a whole load."""
    v = counts.filter(F.col("column_name").isin(columns) & F.col("d").isNotNull() & ~F.isnan("d") & (F.col("d") != 0)).select("load_id", "column_name", F.abs("d").alias("v"), "n")
    v = v.withColumn("bin", F.floor(F.log("v") * BINS))
    key = ["load_id", "column_name"]
    cum = Window.partitionBy(*key).orderBy("bin")
    bins = v.groupBy(*key, "bin").agg(F.sum("n").alias("bn")).withColumn("upto", F.sum("bn").over(cum)).withColumn("total", F.sum("bn").over(Window.partitionBy(*key)))
    at = F.floor((F.col("total") + 1) / 2)
    hit = bins.filter((F.col("upto") >= at) & (F.col("upto") - F.col("bn") < at)).select(*key, "bin", (at - (F.col("upto") - F.col("bn"))).alias("at"))
    within = Window.partitionBy(*key, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return v.join(hit, [*key, "bin"]).withColumn("upto", F.sum("n").over(within)).filter(F.col("upto") >= F.col("at")).groupBy(*key).agg(F.min("v").alias("median_abs"))


def whole_match(value: Column, pattern: Column) -> Column:
    """value matches pattern, with a closing $ that means the very end (Java's would also accept a line break there)."""
    return F.regexp(value, F.when(pattern.endswith("$") & ~pattern.endswith("\\$"), F.concat(pattern.substr(F.lit(1), F.length(pattern) - 1), F.lit("\\z"))).otherwise(pattern))


def check_catalog(counts: DataFrame, catalog: DataFrame, schema: T.StructType) -> DataFrame:
    """(upload_batch_id, column_name, measure): where the catalogue's statements do not hold, or a load differs from the load before.

    Loads or columns of the catalogue that the table does not have give no rows; a stated value that is null is not held against anything; a load without a predecessor has no shifts."""
    types = {f.name: f.dataType for f in schema.fields}
    strings = [c for c, t in types.items() if isinstance(t, T.StringType)]
    doubles = [c for c, t in types.items() if isinstance(t, (T.DoubleType, T.FloatType))]
    spark = counts.sparkSession
    names = spark.createDataFrame([(c, dtype_name(t), c in strings) for c, t in types.items()], "column_name string, real_dtype string, is_string boolean")
    cat = catalog.select("engagement_id", "load_no", F.col("upload_batch_id").alias("load_id"), "column_name", "dtype", F.col("null_rate").alias("said_null"), F.col("distinct_count").alias("said_distinct"), "value_pattern", "min_value", "max_value").join(F.broadcast(names), "column_name")
    before = catalog.select("engagement_id", (F.col("load_no") + 1).alias("load_no"), F.col("upload_batch_id").alias("prev_id")).distinct()
    m = metrics(counts).join(medians(counts, doubles), ["load_id", "column_name"], "left")
    m = m.select("load_id", "column_name", "row_count", "nulls", "null_rate", "distinct_count", "min_num", "max_num", "median_abs")
    prev = m.select(F.col("load_id").alias("prev_id"), "column_name", F.col("null_rate").alias("p_null"), F.col("distinct_count").alias("p_distinct"), F.col("median_abs").alias("p_median"))
    all_ = cat.join(before, ["engagement_id", "load_no"], "left").join(m, ["load_id", "column_name"], "left").join(prev, ["prev_id", "column_name"], "left")

    filled = F.col("row_count") - F.col("nulls")
    patterns = cat.filter(F.col("value_pattern").isNotNull() & F.col("is_string")).select("load_id", "column_name", "value_pattern").distinct()
    bad = counts.filter(F.col("s").isNotNull()).join(patterns, ["load_id", "column_name"]).filter(~whole_match(F.col("s"), F.col("value_pattern"))).groupBy("load_id", "column_name", "value_pattern").agg(F.sum("n").alias("bad"))
    moved = all_.filter(F.col("is_string") & (F.col("p_distinct") <= 50)).select("load_id", "prev_id", "column_name").distinct()
    now = counts.filter(F.col("s").isNotNull()).join(moved, ["load_id", "column_name"]).select("load_id", "prev_id", "column_name", "s", "n")
    then = counts.filter(F.col("s").isNotNull()).join(moved.select(F.col("prev_id").alias("load_id"), "column_name").distinct(), ["load_id", "column_name"]).select(F.col("load_id").alias("prev_id"), "column_name", "s")
    new = now.join(then, ["prev_id", "column_name", "s"], "left_anti").groupBy("load_id", "prev_id", "column_name").agg(F.sum("n").alias("new"))

    wide = all_.join(bad, ["load_id", "column_name", "value_pattern"], "left").join(new, ["load_id", "prev_id", "column_name"], "left")
    holds = {
        "dtype": F.col("dtype") != F.col("real_dtype"),
        "null_rate": F.abs(F.col("said_null") - F.col("null_rate")) > 0.01,
        "distinct_count": F.abs(F.col("said_distinct") - F.col("distinct_count")) > 0.05 * F.col("distinct_count"),
        "pattern": F.col("bad") > 0.02 * filled,
        "range": (F.col("min_num") < F.col("min_value")) | (F.col("max_num") > F.col("max_value")),
        "null_shift": F.abs(F.col("null_rate") - F.col("p_null")) > 0.1,
        "median_shift": F.greatest("median_abs", "p_median") > 5 * F.least("median_abs", "p_median"),
        "domain_shift": F.col("new") > 0.2 * filled,
    }
    both = F.col("median_abs").isNotNull() & F.col("p_median").isNotNull()
    holds["median_shift"] = holds["median_shift"] & both
    measures = F.array(*(F.when(cond, F.lit(k)) for k, cond in holds.items()))
    return wide.select(F.col("load_id").alias("upload_batch_id"), "column_name", F.explode(F.array_compact(measures)).alias("measure"))
