"""From any table to the ledger's columns: name mapping, debit and credit forms, typing in one projection."""

from __future__ import annotations

import difflib
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import melted, to_date, to_flag, to_number

#: Types of the ledger's columns.
LEDGER = {
    "document_id": "str", "company_code": "str", "fiscal_year": "int", "fiscal_period": "int", "posting_date": "datetime", "document_date": "datetime", "document_type": "str", "gl_account": "str", "debit_amount": "float", "credit_amount": "float",
    "local_amount": "float", "currency": "str", "exchange_rate": "float", "reference": "str", "header_text": "str", "created_by": "str", "user_persona": "str", "source": "str", "business_process": "str", "approved_by": "str", "approval_date": "datetime",
    "line_number": "int", "cost_center": "str", "line_text": "str", "tax_code": "str", "tax_amount": "float", "trading_partner": "str", "upload_batch_id": "str", "is_cleared": "bool",
}
#: Other names that columns are known by.
ALIASES = {
    "document_id": ("document number", "belnr", "voucher", "전표번호"), "company_code": ("bukrs", "company", "회사코드"), "posting_date": ("budat", "post date", "전기일"), "document_date": ("bldat", "doc date", "증빙일"), "gl_account": ("hkont", "account", "계정"),
    "debit_amount": ("debit", "차변", "dr"), "credit_amount": ("credit", "대변", "cr"), "fiscal_year": ("gjahr", "year"), "fiscal_period": ("monat", "period"), "document_type": ("blart", "doc type"), "header_text": ("bktxt",), "line_text": ("sgtxt", "description", "적요"), "created_by": ("usnam", "user"),
}


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def map_columns(names: list[str], least: float = 0.85, types: dict[str, str] | None = None, aliases: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """ledger column -> given column, each given one used once: exact names first, then aliases, then the most similar."""
    return {t: n for t, n, _, _ in map_tiers(names, least, types, aliases)}


#: Which inferred types a column's values may have; unknown (a column without values) fits all.
COMPATIBLE = {"int": {"int"}, "float": {"int", "float"}, "datetime": {"date"}, "str": {"str", "int", "float", "date"}, "bool": {"str", "int"}}


def map_tiers(names: list[str], least: float = 0.85, types: dict[str, str] | None = None, aliases: dict[str, tuple[str, ...]] | None = None, patterns: dict[str, dict[str, float]] | None = None) -> list[tuple[str, str, str, float]]:
    """(ledger column, given column, tier, score), each column of either side used once. Tiers: exact, alias, similar (at least `least`), pattern. types (given column -> inferred type) bars names whose values don't fit.
    patterns (given column -> shares of values that look like a kind, see column_patterns) suggest what is left."""
    known = {t: (*ALIASES.get(t, ()), *(aliases or {}).get(t, ())) for t in LEDGER}
    fits = lambda t, n: types is None or types.get(n, "unknown") == "unknown" or types[n] in COMPATIBLE[LEDGER[t]]
    pool, got, used = {n: _plain(n) for n in names}, [], set()

    def take(t: str, n: str, tier: str, score: float) -> None:
        got.append((t, n, tier, round(score, 6)))
        used.add(t)
        del pool[n]

    for tier, accept in (("exact", lambda t, p: p == _plain(t)), ("alias", lambda t, p: p in map(_plain, known[t]))):
        for t in LEDGER:
            if t not in used and (hit := next((n for n, p in pool.items() if accept(t, p) and fits(t, n)), None)):
                take(t, hit, tier, 1.0)
    close = sorted(((difflib.SequenceMatcher(None, _plain(x), p).ratio(), t, n) for t in LEDGER if t not in used for x in (t, *known[t]) for n, p in pool.items()), key=lambda x: (-x[0], x[1], x[2]))
    for r, t, n in close:
        if r >= least and t not in used and n in pool and fits(t, n):
            take(t, n, "similar", r)
    want = {"posting_date": "date", "gl_account": "account", "debit_amount": "amount", "credit_amount": "amount", "company_code": "company", "currency": "currency", "document_id": "identifier"}
    for t, kind in want.items():
        best = max(((v.get(kind, 0.0), n) for n, v in (patterns or {}).items() if n in pool), default=(0.0, ""), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if t not in used and best[0] >= 0.8:
            take(t, best[1], "pattern", best[0])
    return got


def column_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, date, account, amount, company, currency, identifier): how large a share of each column's values looks like what; one scan."""
    v = F.col("v")
    kinds = {"date": r"^\d{4}[-./]?\d{2}[-./]?\d{2}([ T].*)?\z", "account": r"^[0-9]{4,8}\z", "amount": r"^[(+-]?[0-9][0-9,]*\.[0-9]+\)?\z", "company": r"^[A-Z]{1,2}[0-9]{3,4}\z", "currency": r"^[A-Z]{3}\z", "identifier": r"^[A-Z]+-?[0-9-]{5,}\z"}
    g = melted(df, columns, "string").filter(v.isNotNull()).groupBy("column_name")
    return g.agg(F.count(F.lit(1)).alias("n"), *(F.avg(v.rlike(p).cast("int")).alias(k) for k, p in kinds.items()))


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, type) from all values: int or float if more than half are numbers (int if none of these has a fraction), else date if more than half look like one, else str; unknown without values."""
    t = F.trim("v")
    num = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
    day = t.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")
    some = F.col("v").isNotNull()
    g = melted(df, columns, "string").groupBy("column_name").agg(F.count("v").alias("n"), F.count(F.when(some, num)).alias("numbers"), F.count(F.when(num % 1 != 0, 1)).alias("fractions"), F.count_if(day).alias("days"))
    kind = F.when(F.col("n") == 0, "unknown").when((F.col("numbers") > 0.5 * F.col("n")) & (F.col("fractions") == 0), "int").when(F.col("numbers") > 0.5 * F.col("n"), "float").when(F.col("days") > 0.5 * F.col("n"), "date").otherwise("str")
    return g.select("column_name", kind.alias("type"))


class Profiles:
    """Saved mappings as JSON files in a folder, each named by the fingerprint of the columns it is for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, names: list[str], mapping: dict[str, str]) -> str:
        f = fingerprint(names)
        p, fs = self._path(f)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"columns": sorted(names), "mapping": mapping}, ensure_ascii=False).encode()))
        out.close()
        return f

    def load(self, names: list[str]) -> dict[str, str] | None:
        """The mapping saved for exactly these columns, in whatever order."""
        p, fs = self._path(fingerprint(names))
        if not fs.exists(p):
            return None
        at = fs.open(p)
        try:
            return json.loads(bytes(at.readAllBytes()).decode())["mapping"]
        finally:
            at.close()


def profile_diff(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
    """(ledger column, change, before, after): added, removed or moved."""
    out = []
    for t in sorted({*before, *after}):
        a, b = before.get(t), after.get(t)
        if a != b:
            out.append((t, "added" if a is None else "removed" if b is None else "moved", a, b))
    return out


def learned(mapping: dict[str, str], aliases: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """Aliases with the names of a confirmed mapping that weren't known."""
    out = {t: tuple(v) for t, v in (aliases or {}).items()}
    for t, n in mapping.items():
        if _plain(n) != _plain(t) and _plain(n) not in map(_plain, (*ALIASES.get(t, ()), *out.get(t, ()))):
            out[t] = (*out.get(t, ()), n)
    return out


def repaired(c: Column) -> Column:
    """UTF-8 that was read as a one-byte code page, read rightly: texts whose characters all fit in one byte each and whose bytes are valid UTF-8. Others, and plain ASCII, stay."""
    whole = c.rlike(r"^[\x00-\xff]*\z") & c.rlike(r"[\x80-\xff]")
    return F.coalesce(F.when(whole, F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))), c)


def fingerprint(names: list[str]) -> str:
    """Of a set of columns, however ordered; names a saved mapping."""
    return hashlib.sha256("\n".join(sorted(n.strip().lower() for n in names)).encode()).hexdigest()[:12]


def unify_sides(df: DataFrame) -> DataFrame:
    """debit_amount and credit_amount from whichever form there is: both; amount with dc_indicator; one signed amount."""
    have = set(df.columns)
    if {"debit_amount", "credit_amount"} <= have or "amount" not in have:
        return df
    a = to_number(F.col("amount"))
    if "dc_indicator" in have:
        debit = F.lower(F.trim("dc_indicator")).isin("s", "d", "dr", "debit", "차변", "40")
        return df.withColumns({"debit_amount": F.when(debit, F.abs(a)).otherwise(0.0), "credit_amount": F.when(~debit, F.abs(a)).otherwise(0.0)})
    return df.withColumns({"debit_amount": F.greatest(a, F.lit(0.0)), "credit_amount": F.greatest(-a, F.lit(0.0))})


def typed(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """The ledger's columns, typed; values that don't fit become null, columns that are absent are null throughout. One projection."""
    mapping = map_columns(df.columns) if mapping is None else mapping
    df = unify_sides(df.withColumnsRenamed({n: t for t, n in mapping.items()}))
    text = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c.cast("string"), "[​﻿]", ""), r"^(-?[0-9]+)\.0\z", "$1")), F.lit(""))
    cast = {"str": text, "int": lambda c: F.round(to_number(c)).cast("bigint"), "float": to_number, "datetime": lambda c: to_date(c).cast("timestamp_ntz"), "bool": to_flag}
    null = {"str": "string", "int": "bigint", "float": "double", "datetime": "timestamp_ntz", "bool": "boolean"}
    return df.select(*((cast[k](F.col(c)) if c in df.columns else F.lit(None).cast(null[k])).alias(c) for c, k in LEDGER.items()))
