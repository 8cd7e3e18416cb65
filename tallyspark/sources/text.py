"""Delimited text as it is found: records over several lines, quotes that never close, mixed separators, lines of other widths.

A file is read by splits, whatever its size. Whether a line goes on with the record before it follows from the number of quotation marks before
it: marks are counted per split, the counts of splits are summed up (a row per split), and lines are numbered within their split, so no
file is ever in one task. A record of more than `most` lines is taken for a quote that never closes, and its lines stand alone.

Defined results: an empty file gives no rows; blank lines give none; a field is null if nothing is left of it; fields beyond the header's
width are kept in _more; a line that is no record in its quoting is cut at separators and its marks are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators that lines of a file may have besides its own.
OTHER = (";", "\t", "|", ",")
MOST = 1000


def marks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, no, line): lines in the order of (file, block, no)."""
    t = spark.read.option("encoding", encoding).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.regexp_replace("value", "[\r﻿]+$|^﻿", "").alias("line"))


def _running(df: DataFrame, what: str, name: str) -> DataFrame:
    """The sum of `what` over a file's lines up to and including each, in two levels."""
    per = df.groupBy("file", "block").agg(F.sum(what).alias("_s"))
    per = per.withColumn("_before", F.sum("_s").over(Window.partitionBy("file").orderBy("block")) - F.col("_s")).drop("_s")  # a row per split
    w = Window.partitionBy("file", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return df.join(F.broadcast(per), ["file", "block"]).withColumn(name, F.sum(what).over(w) + F.col("_before")).drop("_before")


def records(lines: DataFrame, most: int = MOST) -> DataFrame:
    """(file, rec, n_lines, record): lines put together to records, in order of (file, rec)."""
    x = _running(lines.withColumn("_odd", marks(F.col("line")) % 2), "_odd", "_upto")
    x = x.withColumn("_starts", ((F.col("_upto") - F.col("_odd")) % 2 == 0).cast("int"))
    x = _running(x, "_starts", "rec")
    size = x.groupBy("file", "rec").agg(F.count(F.lit(1)).alias("n_lines"))
    several, place = size.filter("n_lines > 1"), F.struct("block", "no")
    alone = x.join(several, ["file", "rec"], "left_anti").select("file", "rec", F.lit(1).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("part"), "line")
    long = x.join(several.filter(F.col("n_lines") > most), ["file", "rec"]).select("file", "rec", F.lit(1).cast("bigint").alias("n_lines"), F.monotonically_increasing_id().alias("part"), "line")
    put = x.join(several.filter(F.col("n_lines") <= most), ["file", "rec"]).groupBy("file", "rec", "n_lines").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "line"))), lambda s: s["line"]), "\n").alias("line"))
    put = put.select("file", "rec", "n_lines", F.lit(0).cast("bigint").alias("part"), "line")
    return alone.unionByName(long).unionByName(put).filter(~F.col("line").rlike(r"^\s*\z")).withColumnRenamed("line", "record")


def cells(record: Column, sep: str = ",") -> Column:
    """The fields of a record; of one that is broken in its quoting, what lies between separators, without marks at the ends."""
    from ..operators.parse import split_quoted

    well, fields = split_quoted(record, sep)
    plain = F.transform(F.split(record, "\\Q" + sep + "\\E", -1), lambda f: F.replace(F.regexp_replace(f, '^"+|"+$', ""), F.lit('""'), F.lit('"')))
    return F.when(well, fields).otherwise(plain)


def tidy_cells(c: Column) -> Column:
    return F.transform(c, lambda f: F.nullif(F.trim(f), F.lit("")))


def other_separator(c: Column, width: int, sep: str = ",") -> Column:
    """The separator by which a row that fills its first field alone falls into at least half of the width; null if there is none."""
    lone = (F.size(c) >= 1) & F.get(c, F.lit(0)).isNotNull() & F.forall(F.slice(c, 2, 1_000_000), lambda f: f.isNull())
    first = F.get(c, F.lit(0))
    return F.coalesce(*(F.when(lone & (F.size(F.split(first, "\\Q" + o + "\\E", -1)) >= width * 0.5), F.lit(o)) for o in OTHER if o != sep))


def remixed(df: DataFrame, column: str, width: int, sep: str = ",") -> DataFrame:
    """df with the array column's rows of another separator cut by that, and other_sep saying by which."""
    o = other_separator(F.col(column), width, sep)
    x = df.withColumn("other_sep", o)
    cut = F.coalesce(*(F.when(F.col("other_sep") == s, F.slice(F.split(F.get(column, F.lit(0)), "\\Q" + s + "\\E", -1), 1, width)) for s in OTHER if s != sep))
    return x.withColumn(column, F.when(F.col("other_sep").isNotNull(), tidy_cells(cut)).otherwise(F.col(column)))


def rejoined(df: DataFrame, column: str, file: str, order: list[str], most: int = MOST) -> DataFrame:
    """Rows that fill their first field alone are the rest of a text that a line break has cut: they are put behind the last filled field of the row before. At most `most` to a row; more are left as they are.

    order must be unique within a file; rows are numbered by it within ranges, so it may be anything that sorts."""
    lone = (F.size(column) >= 1) & F.get(column, F.lit(0)).isNotNull() & F.forall(F.slice(column, 2, 1_000_000), lambda f: f.isNull())
    x = df.repartitionByRange(file, *order).withColumn("block", F.spark_partition_id()).withColumn("file", F.col(file)).withColumn("_lone", lone)
    from ..session import written

    x = written(x.withColumns({"no": F.row_number().over(Window.partitionBy("file", "block").orderBy(*order)), "_own": (~F.col("_lone")).cast("int")}), "rows")
    x = _running(x, "_own", "rec")
    tails = x.filter(F.col("_lone") & (F.col("rec") > 0))
    n = tails.groupBy("file", "rec").agg(F.count(F.lit(1)).alias("n_tails"))
    few = n.filter(F.col("n_tails") <= most)
    text = tails.join(few, ["file", "rec"]).groupBy("file", "rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "no", F.get(column, F.lit(0)).alias("t")))), lambda s: s["t"]), "\n").alias("_tail"))
    kept = x.filter(~F.col("_lone") | (F.col("rec") == 0)).unionByName(tails.join(few, ["file", "rec"], "left_anti"))
    y = kept.join(text.withColumn("_lone", F.lit(False)), ["file", "rec", "_lone"], "left")
    last = F.array_max(F.transform(F.col(column), lambda f, i: F.when(f.isNotNull(), i)))
    out = F.when(F.col("_tail").isNull(), F.col(column)).otherwise(F.transform(F.col(column), lambda f, i: F.when(i == last, F.concat_ws("\n", f, F.col("_tail"))).otherwise(f)))
    return y.withColumn(column, out).drop(*({"file", "block", "no", "rec", "_lone", "_own", "_tail"} - set(df.columns)))


def diagnosis(df: DataFrame, column: str, raw: str, width: int | None = None, sep: str = ",") -> DataFrame:
    """(issue, n) of rows with an array of fields: empty rows, rows with fewer or more fields than the usual number (or `width`), rows of another separator, rows broken in their quoting, and empty columns."""
    from ..operators.parse import split_quoted

    filled = F.exists(column, lambda f: f.isNotNull())
    if width is None:
        usual = df.filter(filled).groupBy(F.size(column).alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
        width = usual["w"] if usual else 0
    well, _ = split_quoted(F.col(raw), sep)
    size = F.size(column)
    tests = {
        "empty_rows": F.coalesce(~filled, F.lit(True)), "short_rows": filled & (size < width), "long_rows": filled & (size > width), "mixed_separator_rows": other_separator(F.col(column), width, sep).isNotNull(), "broken_quoting_rows": filled & ~well,
    }
    seen = [F.max(F.get(column, F.lit(k)).isNotNull()).alias(f"_c{k}") for k in range(width)]
    one = df.agg(*(F.count(F.when(t, 1)).alias(k) for k, t in tests.items()), *seen)
    empty = reduce(lambda a, b: a + b, (F.when(F.col(f"_c{k}"), 0).otherwise(1) for k in range(width)), F.lit(0)).cast("bigint")
    return one.withColumn("empty_columns", empty).unpivot([], [*tests, "empty_columns"], "issue", "n")


def without_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows and columns that hold nothing."""
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))
    seen = df.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in columns)).first()
    return df.filter(some).drop(*(c for c in columns if not seen[c]))


def read_repaired(spark: SparkSession, path: str, names: list[str], sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """A file's rows as strings under the given names, repaired: records over lines, unclosed quotes, other separators, cut texts. _more holds fields beyond the names."""
    r = records(lines_of(spark, path, encoding))
    x = remixed(r.withColumn("cells", tidy_cells(cells(F.col("record"), sep))), "cells", len(names), sep)
    x = rejoined(x, "cells", "file", ["rec", "part"])
    if header:
        first = F.array(*(F.lit(n) for n in names))
        x = x.filter(~((F.col("rec") == 1) & (F.slice("cells", 1, len(names)) == first)))
    more = F.slice("cells", len(names) + 1, 1_000_000)
    return x.select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)), F.when(F.size(more) > 0, more).alias("_more"))
