"""Loading raw delimited records: valid rows typed, every other row with the reasons why it did not load.

The quoting is resolved by built-in string functions: a record is cut at its quotation marks; the pieces at even
positions lie outside quotes. The cells are then exploded into (record, column, value), a table of rules is joined, the
failing cells are the errors, and the clean rows are what an anti-join leaves. Nothing runs in Python.

Defined results: a null or blank record has only column_count; a record whose quoting is broken has only quoting; a
line break outside quotes is a character like any other (a record is given, so it cannot end one); a
record with another number of fields only column_count; an amount may have a minus sign of either kind, and must not end in its point; an empty table gives empty results; repeated records are
judged each by itself; very long records are cut in linear time, without backtracking; other columns of the input,
of whatever names, are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUM = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
#: What a cell must match, by kind of rule; the end is \z since $ would allow a line break.
PATTERNS = {
    "amount": rf"^(?:|[+\-−]?{_NUM}|\({_NUM}\))\z",
    "period": r"^0*(?:[1-9]|1[0-6])\z",
    "date": r"^(?:19|[2-9][0-9])[0-9]{2}-[0-9]{2}-[0-9]{2}(?: (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?\z",
}
# Two characters that stand for a separator; the first of them, where the text has it, is itself escaped.
_ESC, _SEP, _LIT = "\x01", "\x01s", "\x01e"


@dataclass(frozen=True)
class Layout:
    """Names of the fields in order, and the rule kind of those that are checked."""

    fields: tuple[str, ...]
    rules: tuple[tuple[str, str], ...]  # (field, kind of PATTERNS)


JOURNAL = Layout(
    ("document_id", "company_code", "fiscal_year", "fiscal_period", "posting_date", "document_date", "document_type", "gl_account", "debit_amount", "credit_amount", "header_text"),
    (("fiscal_period", "period"), ("posting_date", "date"), ("debit_amount", "amount"), ("credit_amount", "amount")),
)


def split_quoted(line: Column, sep: str = ",") -> tuple[Column, Column]:
    """(well_formed, fields) of a record whose fields are separated by one character."""
    segs = F.split(F.replace(F.coalesce(line, F.lit("")), F.lit(_ESC), F.lit(_LIT)), '"', -1)
    last = F.size(segs) - 1
    # outside quotes: nothing (a doubled mark or an end), or text that the neighbouring quoted fields are cut off from by commas
    outside_ok = F.forall(
        F.transform(segs, lambda s, i: (i % 2 == 1) | (s == "") | (((i == 0) | s.startswith(sep)) & ((i == last) | s.endswith(sep)))),
        lambda ok: ok,
    )
    well = (F.size(segs) % 2 == 1) & outside_ok
    joined = F.array_join(
        F.transform(segs, lambda s, i: F.when(i % 2 == 1, s).when((s == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(s, F.lit(sep), F.lit(_SEP)))), ""
    )
    fields = F.transform(F.split(joined, _SEP, -1), lambda f: F.replace(f, F.lit(_LIT), F.lit(_ESC)))
    return well, fields


def amount(cell: Column) -> Column:
    """A cell that matches PATTERNS['amount'] as a number; empty is null, parentheses mean negative."""
    digits = F.replace(F.regexp_replace(cell, r"[,()+]", ""), F.lit("−"), F.lit("-")).try_cast("double")
    return F.when(cell.startswith("("), -digits).otherwise(digits)


def parsed(df: DataFrame, id_col: str, raw_col: str, layout: Layout = JOURNAL) -> DataFrame:
    """(record_id, reason, cells): reason is set where the record as a whole cannot be read."""
    well, fields = split_quoted(F.col(raw_col))
    blank = F.col(raw_col).isNull() | ~F.col(raw_col).rlike(r"\S")
    base = df.select(F.col(id_col).alias("record_id"), blank.alias("blank"), well.alias("well"), fields.alias("cells"))
    reason = F.when(F.col("blank"), "column_count").when(~F.col("well"), "quoting").when(F.size("cells") != len(layout.fields), "column_count")
    return base.select("record_id", reason.alias("reason"), F.transform("cells", lambda c: F.trim(c)).alias("cells"))


def _bad_date(v: Column) -> Column:
    return ~v.rlike(PATTERNS["date"]) | F.try_to_date(v.substr(1, 10), "yyyy-MM-dd").isNull()


def errors(p: DataFrame, layout: Layout = JOURNAL) -> DataFrame:
    """(record_id, reason), one row per record and reason, of what parsed() gave."""
    # what is wrong with a record as a whole goes through the same join, as a cell at -1 that holds its reason
    spark = p.sparkSession
    rules = spark.createDataFrame([(-1, None, "whole"), *((layout.fields.index(f), f, k) for f, k in layout.rules)], "pos int, rule_reason string, kind string")
    cell = lambda pos, value: F.struct(pos.cast("int").alias("pos"), value.alias("value"))
    each = F.when(F.col("reason").isNotNull(), F.array(cell(F.lit(-1), F.col("reason")))).otherwise(F.transform("cells", lambda v, k: cell(k, v)))
    judged = p.select("record_id", F.inline(each)).join(F.broadcast(rules), "pos")  # a constant table: one row per checked field
    v, kind = F.col("value"), F.col("kind")
    bad = F.when(kind == "period", ~v.rlike(PATTERNS["period"])).when(kind == "date", _bad_date(v)).when(kind == "amount", ~v.rlike(PATTERNS["amount"])).otherwise(True)
    return judged.filter(bad).select("record_id", F.coalesce("rule_reason", "value").alias("reason"))


def error_report(err: DataFrame) -> DataFrame:
    """One row per record that did not load: its reasons, in order, as one string."""
    return err.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def valid_rows(p: DataFrame, err: DataFrame, layout: Layout = JOURNAL) -> DataFrame:
    """The typed rows: those of p whose record_id has no error."""
    clean = p.filter("reason is null").join(err.select("record_id").distinct(), "record_id", "left_anti")
    kinds, at = dict(layout.rules), lambda k: F.get("cells", F.lit(k))
    out = [F.col("record_id")]
    for k, f in enumerate(layout.fields):
        kind = kinds.get(f)
        if kind == "amount":
            out.append(amount(at(k)).alias(f))
        elif kind == "period":
            out.append(at(k).try_cast("int").alias(f))
        elif kind == "date":
            out.append(F.coalesce(F.expr(f"try_to_timestamp(cells[{k}], 'yyyy-MM-dd HH:mm:ss')"), F.expr(f"try_to_timestamp(cells[{k}], 'yyyy-MM-dd')")).cast("timestamp_ntz").alias(f))
        else:
            out.append(at(k).alias(f))
    return clean.select(*out)
