"""Queries of reading, mapping, typing and writing, with their SQL equivalents. Where an operator works on files, the query writes them from the tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as S
from ..functions import to_date, to_flag, to_number
from ..operators import features as X
from ..operators import learn as L
from ..operators import sinks
from ..session import cached, new_path, read, spread
from ..sources import mapping as M
from ..sources import readers, sidecars, text
from . import ledger
from .ledger import Query, gl_of
from .problems import _P4
from .surface import where

_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def values(columns: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


# ---- casts
@query("SELECT row_id, CASE WHEN row_id % 6 IN (1, 3) THEN -round(abs(local_amount), 2) WHEN row_id % 6 = 5 THEN NULL ELSE round(abs(local_amount), 2) END AS v FROM general_ledger WHERE local_amount IS NOT NULL")
def cast_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written as people do, read back."""
    plain = F.round(F.abs("local_amount"), 2).cast("decimal(20,2)").cast("string")
    thousands = F.format_number(F.round(F.abs("local_amount"), 2).cast("decimal(20,2)"), 2)
    forms = F.array(thousands, F.concat(F.lit("("), thousands, F.lit(")")), F.concat(F.lit(" ₩"), thousands), F.concat(plain, F.lit("-")), plain, F.lit("n/a"))
    x = gl_of(spark, d).filter("local_amount is not null").select("row_id", F.get(forms, (F.col("row_id") % 6).cast("int")).alias("t"))
    return x.select("row_id", to_number(F.col("t")).alias("v"))


@query("SELECT row_id, CASE WHEN row_id % 6 < 5 THEN strftime(posting_date, '%Y-%m-%d') END AS day FROM general_ledger WHERE posting_date IS NOT NULL")
def cast_dates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("posting_date")
    serial = (F.datediff(p.cast("date"), F.lit("1899-12-30").cast("date"))).cast("string")
    forms = F.array(F.date_format(p, "yyyy-MM-dd HH:mm:ss"), F.date_format(p, "yyyyMMdd"), F.date_format(p, "dd.MM.yyyy"), F.date_format(p, "yyyy/MM/dd"), serial, F.lit("2024-13-45"))
    x = gl_of(spark, d).filter("posting_date is not null").select("row_id", F.get(forms, (F.col("row_id") % 6).cast("int")).alias("t"))
    return x.select("row_id", F.date_format(to_date(F.col("t")), "yyyy-MM-dd").alias("day"))


@query("SELECT row_id, [1, 0, 1, 0, 1, NULL][row_id % 6 + 1]::INTEGER AS flag FROM general_ledger")
def cast_flags(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*map(F.lit, ("Y", " no ", "1", "0.0", "TRUE", "maybe")))
    return gl_of(spark, d).select("row_id", to_flag(F.get(forms, (F.col("row_id") % 6).cast("int"))).cast("int").alias("flag"))


_SIDES = "greatest(coalesce(debit_amount, 0.0), coalesce(credit_amount, 0.0))"


@query(f"""
    WITH t AS (SELECT row_id, {_SIDES} AS a, coalesce(debit_amount, 0.0) > coalesce(credit_amount, 0.0) AS is_debit FROM general_ledger)
    SELECT row_id, form, CASE WHEN is_debit THEN a ELSE 0.0 END AS debit_amount, CASE WHEN is_debit THEN 0.0 ELSE a END AS credit_amount FROM t, (VALUES ('indicator'), ('signed')) f(form)""")
def sides_unified(spark: SparkSession, d: str) -> DataFrame:
    """Debit and credit from an amount with an indicator, and from a signed amount."""
    debit = F.coalesce("debit_amount", F.lit(0.0)) > F.coalesce("credit_amount", F.lit(0.0))
    t = gl_of(spark, d).select("row_id", F.greatest(F.coalesce("debit_amount", F.lit(0.0)), F.coalesce("credit_amount", F.lit(0.0))).alias("a"), debit.alias("is_debit"))
    one = M.unify_sides(t.select("row_id", F.lit("indicator").alias("form"), F.col("a").alias("amount"), F.when(F.col("is_debit"), "S").otherwise("H").alias("dc_indicator")))
    two = M.unify_sides(t.select("row_id", F.lit("signed").alias("form"), F.when(F.col("is_debit"), F.col("a")).otherwise(-F.col("a")).alias("amount")))
    keep = ("row_id", "form", "debit_amount", (F.col("credit_amount") + 0.0).alias("credit_amount"))
    return one.select(*keep).unionByName(two.select(*keep))


@query("""
    SELECT row_id, nullif(trim(document_id), '') AS document_id, fiscal_year::BIGINT AS fiscal_year, strftime(posting_date, '%Y-%m-%d %H:%M:%S') AS posting_date, nullif(trim(regexp_replace(gl_account, '^(-?[0-9]+)\\.0$', '\\1')), '') AS gl_account, debit_amount, currency IS NULL AND local_amount IS NULL AS absent
    FROM (SELECT * REPLACE (NULL AS currency, NULL AS local_amount) FROM general_ledger)""")
def ledger_typed(spark: SparkSession, d: str) -> DataFrame:
    """A table of strings under a system's own names, mapped and typed in one projection; what it lacks is null."""
    gl = gl_of(spark, d)
    raw = gl.select(F.col("row_id").alias("upload_batch_id"), F.col("document_id").alias("BELNR"), F.col("fiscal_year").cast("string").alias("GJAHR"), F.date_format("posting_date", "yyyy-MM-dd HH:mm:ss").alias("Budat"), F.col("gl_account").alias("HKONT"), F.col("debit_amount").cast("string").alias("debit"))
    t = M.typed(raw)
    return t.select(F.col("upload_batch_id").cast("bigint").alias("row_id"), "document_id", "fiscal_year", F.date_format("posting_date", "yyyy-MM-dd HH:mm:ss").alias("posting_date"), "gl_account", "debit_amount", (F.col("currency").isNull() & F.col("local_amount").isNull()).alias("absent"))


# ---- mapping
_NAMES = ["BELNR", "Company Code", "budat", "hkont", "debit", "Credit_Amount", "postng_dat", "fiscal yeer", "sgtxt", "ref", "unrelated"]


@query(values("ledger_column, given_column, tier", [("company_code", "Company Code", "exact"), ("credit_amount", "Credit_Amount", "exact"), ("document_id", "BELNR", "alias"), ("posting_date", "budat", "alias"), ("gl_account", "hkont", "alias"), ("debit_amount", "debit", "alias"), ("line_text", "sgtxt", "alias"), ("fiscal_year", "fiscal yeer", "similar")]))
def column_mapping(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([r[:3] for r in M.map_tiers(_NAMES)], "ledger_column string, given_column string, tier string")


@query(values("ledger_column, given_column, tier", [("posting_date", "c5", "pattern"), ("gl_account", "c8", "pattern"), ("company_code", "c2", "pattern")]))
def column_mapping_by_values(spark: SparkSession, d: str) -> DataFrame:
    """Columns without telling names, by what their values look like."""
    gl = gl_of(spark, d).select(F.col("company_code").alias("c2"), F.date_format("posting_date", "yyyy-MM-dd").alias("c5"), F.col("gl_account").alias("c8"), F.col("line_text").alias("c9"))
    seen = {r["column_name"]: {k: r[k] for k in ("date", "account", "amount", "company", "currency", "identifier")} for r in M.column_patterns(gl, gl.columns).collect()}  # a row per column
    return spark.createDataFrame([r[:3] for r in M.map_tiers(gl.columns, patterns=seen)], "ledger_column string, given_column string, tier string")


_TYPED = ["document_id", "fiscal_year", "posting_date", "gl_account", "debit_amount", "header_text", "line_number"]


@query(" UNION ALL ".join(f"""(WITH t AS (SELECT {c}::VARCHAR AS v FROM general_ledger WHERE {c} IS NOT NULL), n AS (SELECT v, CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(v) AS DOUBLE) END AS x FROM t)
    SELECT '{c}' AS column_name, CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(x) > 0.5 * count(*) THEN CASE WHEN count(*) FILTER (WHERE x % 1 <> 0) = 0 THEN 'int' ELSE 'float' END
    WHEN count(*) FILTER (WHERE regexp_matches(trim(v), '^[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}')) > 0.5 * count(*) THEN 'date' ELSE 'str' END AS type FROM n)""" for c in _TYPED))
def column_types(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    return M.inferred_types(gl.select(*(F.col(c).cast("string").alias(c) for c in _TYPED)), _TYPED)


@query(values("ledger_column, change, before_column, after_column", [("currency", "added", None, "waers"), ("gl_account", "moved", "hkont", "konto"), ("line_text", "removed", "sgtxt", None)]))
def mapping_profile_changes(spark: SparkSession, d: str) -> DataFrame:
    """A mapping saved, loaded by the same columns in another order, and held against a newer one."""
    p = M.Profiles(spark, new_path(spark, "profiles"))
    p.save(["belnr", "hkont", "sgtxt"], {"document_id": "belnr", "gl_account": "hkont", "line_text": "sgtxt"})
    diff = M.profile_diff(p.load(["sgtxt", "HKONT ", "belnr"]) or {}, {"document_id": "belnr", "gl_account": "konto", "currency": "waers"})
    return spark.createDataFrame(diff, "ledger_column string, change string, before_column string, after_column string")


@query(values("ledger_column, alias", [("document_id", "Beleg"), ("gl_account", "Sachkonto")]))
def aliases_learned(spark: SparkSession, d: str) -> DataFrame:
    got = M.learned({"document_id": "Beleg", "gl_account": "Sachkonto", "posting_date": "budat", "currency": "Currency"})
    return spark.createDataFrame([(t, a) for t, names in got.items() for a in names], "ledger_column string, alias string")


@query("SELECT row_id, header_text FROM general_ledger")
def mojibake_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Texts read as a one-byte code page, repaired."""
    garbled = F.decode(F.encode("header_text", "UTF-8"), "ISO-8859-1")
    return spread(gl_of(spark, d).select("row_id", "header_text")).select("row_id", M.repaired(garbled).alias("header_text"))


# ---- files
_WELL = "r.well AND regexp_matches(raw_line, '\\S')"


@query(f"""
    WITH {_P4}, w AS (SELECT len(c) AS n, count(*) AS k FROM f JOIN r USING (record_id) WHERE regexp_matches(raw_line, '\\S') GROUP BY 1), u AS (SELECT 11 AS w),
    p AS (SELECT record_id, raw_line, well, CASE WHEN well THEN list_transform(c, lambda x: nullif(x, '')) ELSE [] END AS c FROM r LEFT JOIN f USING (record_id) WHERE raw_line IS NOT NULL AND well),
    x AS (SELECT *, len(list_filter(c, lambda x: x IS NOT NULL)) AS filled FROM p)
    SELECT 'empty_rows' AS issue, count(*) FILTER (WHERE filled = 0) AS n FROM x UNION ALL SELECT 'short_rows', count(*) FILTER (WHERE filled > 0 AND len(c) < 11) FROM x UNION ALL SELECT 'long_rows', count(*) FILTER (WHERE filled > 0 AND len(c) > 11) FROM x
    UNION ALL SELECT 'mixed_separator_rows', count(*) FILTER (WHERE filled = 1 AND c[1] IS NOT NULL AND greatest(len(string_split(c[1], ';')), len(string_split(c[1], chr(9))), len(string_split(c[1], '|'))) >= 5.5) FROM x
    UNION ALL SELECT 'broken_quoting_rows', 0 UNION ALL SELECT 'empty_columns', 11 - (SELECT count(*) FROM (SELECT DISTINCT i FROM (SELECT unnest(c) AS v, generate_subscripts(c, 1) AS i FROM x) WHERE v IS NOT NULL AND i <= 11)) """)
def text_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the well-quoted records of the raw export."""
    x = _raw(spark, d)
    return text.diagnosis(x, "cells", "raw_line", 11)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.parse import split_quoted

    j = read(spark, d, "journal_entries").filter("raw_line is not null")
    well, fields = split_quoted(F.col("raw_line"))
    return j.filter(well).select("record_id", "raw_line", text.tidy_cells(fields).alias("cells"))


@query(f"""
    WITH {_P4}, p AS (SELECT record_id, list_transform(c, lambda x: nullif(x, '')) AS c FROM r JOIN f USING (record_id) WHERE raw_line IS NOT NULL),
    m AS (SELECT record_id, string_split(c[1], ';') AS s FROM p WHERE len(list_filter(c, lambda x: x IS NOT NULL)) = 1 AND c[1] IS NOT NULL AND len(string_split(c[1], ';')) >= 5.5)
    SELECT record_id, ';' AS other_sep, trim(s[1], ' ') AS first_field, least(len(s), 11)::INTEGER AS n_fields FROM m""")
def text_remixed(spark: SparkSession, d: str) -> DataFrame:
    """Records of another separator, cut by that."""
    x = text.remixed(_raw(spark, d), "cells", 11).filter("other_sep is not null")
    return x.select("record_id", "other_sep", F.get("cells", F.lit(0)).alias("first_field"), F.size("cells").alias("n_fields"))


@query(f"""
    WITH {_P4} SELECT raw_line AS record, count(*) AS n FROM r WHERE {_WELL} AND NOT regexp_matches(regexp_replace(raw_line, '"([^"]|"")*"', '', 'g'), '[\\r\\n]') AND raw_line NOT LIKE '%' || chr(13) || '%' GROUP BY 1""")
def text_records(spark: SparkSession, d: str) -> DataFrame:
    """Well-quoted records written to files as lines, read by splits and put together again."""
    x = _raw(spark, d).filter(r"raw_line rlike '\\S'").filter(~F.regexp_replace("raw_line", '"([^"]|"")*"', "").rlike("[\r\n]") & ~F.col("raw_line").contains("\r"))
    at = new_path(spark, "lines")
    x.select("raw_line").write.text(at)
    return text.records(text.lines_of(spark, at)).groupBy("record").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT gl_account AS account, min(company_code) AS name, NULL::VARCHAR AS category FROM general_ledger WHERE trim(gl_account) <> '' AND gl_account = trim(gl_account) AND NOT regexp_matches(gl_account, '[\",\\s]') GROUP BY 1")
def chart_from_csv(spark: SparkSession, d: str) -> DataFrame:
    g = gl_of(spark, d).filter(r"""trim(gl_account) <> '' and gl_account = trim(gl_account) and not gl_account rlike '[",\\s]'""").groupBy("gl_account").agg(F.min("company_code").alias("company_code"))
    at = new_path(spark, "chart") + ".csv"
    g.coalesce(1).write.option("header", True).csv(at + "-parts")
    fs = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(at + "-parts")) if s.getPath().getName().endswith(".csv"))
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(at))
    return sidecars.chart_of_accounts(spark, at)


@query("""
    SELECT 'vendor_invoices_headers' AS table_name, count(*) AS n FROM (SELECT DISTINCT document_id, vendor_id FROM vendor_invoice_headers WHERE document_id IS NOT NULL)
    UNION ALL SELECT 'vendor_invoices_lines', count(*) FROM vendor_invoice_headers WHERE document_id IS NOT NULL UNION ALL SELECT 'vendor_invoices_references', count(purchase_order_id) FROM vendor_invoice_headers WHERE document_id IS NOT NULL
    UNION ALL SELECT 'employees', count(*) FROM employees UNION ALL SELECT 'anomaly_labels', count(*) FROM general_ledger WHERE coalesce(debit_amount, 0) < 0""")
def sidecar_tables(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents, a master and labels written as sidecar files, and all that are there loaded."""
    at = new_path(spark, "sidecars")
    v = read(spark, d, "vendor_invoice_headers").filter("document_id is not null")
    # the items of one document are its invoice's rows, a handful
    nested = v.groupBy(F.struct("document_id", "vendor_id").alias("header")).agg(F.collect_list(F.struct("net_amount", "tax_amount")).alias("items"), F.collect_list(F.when(F.col("purchase_order_id").isNotNull(), F.struct("purchase_order_id"))).alias("references"))
    nested.write.json(f"{at}/document_flows/vendor_invoices.json")
    read(spark, d, "employees").write.json(f"{at}/master_data/employees.json")
    gl_of(spark, d).filter("coalesce(debit_amount, 0) < 0").select("document_id", F.lit("NegativeDebit").alias("anomaly_type")).write.json(f"{at}/labels/anomaly_labels.json")
    out = None
    for k, t in sidecars.load_all(spark, at, "L1").items():
        one = t.agg(F.lit(k).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    SELECT v.document_id, v.net_amount, v.vendor_id FROM vendor_invoice_headers v WHERE document_id IS NOT NULL""")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents nested and taken apart again."""
    v = read(spark, d, "vendor_invoice_headers").filter("document_id is not null")
    nested = v.groupBy(F.struct("document_id").alias("header")).agg(F.collect_list(F.struct("net_amount", "vendor_id")).alias("items"))
    return readers.flow_tables(nested)[1]


@query("""
    WITH o AS (SELECT upload_batch_id AS l, count(*) AS n FROM general_ledger GROUP BY 1), s AS (SELECT upload_batch_id AS l, max(row_count) AS n FROM s0_column_catalog GROUP BY 1)
    SELECT coalesce(s.l, o.l) AS upload_batch_id, s.n AS stated, o.n AS observed, CASE WHEN o.n IS NULL THEN 'absent' WHEN s.n IS NULL THEN 'unstated' WHEN s.n = o.n THEN 'same' ELSE 'differs' END AS state FROM s FULL JOIN o ON s.l = o.l""")
def loads_reconciled(spark: SparkSession, d: str) -> DataFrame:
    stated = read(spark, d, "s0_column_catalog").groupBy("upload_batch_id").agg(F.max("row_count").alias("n"))
    return sidecars.reconciled(stated, gl_of(spark, d).groupBy("upload_batch_id").agg(F.count(F.lit(1)).alias("n")), "upload_batch_id", "n")


@query("SELECT DISTINCT case_id, band, score FROM contract_v2_group_top_case_eval")
def labels_apart(spark: SparkSession, d: str) -> DataFrame:
    return sidecars.split_labels(read(spark, d, "contract_v2_group_top_case_eval").select("case_id", "theme_id", "band", "score"), ["band", "score"], "case_id")[1]


@query("""
    WITH l AS (SELECT case_id, min(band) AS band, count(*) AS n_labels FROM contract_v2_group_top_case_eval WHERE case_id IS NOT NULL AND band IS NOT NULL GROUP BY 1)
    SELECT row_id, l.band AS first_band, n_labels FROM contract_v2_group_top_case_eval c LEFT JOIN l USING (case_id)""")
def labels_joined(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contract_v2_group_top_case_eval")
    return sidecars.labelled(c.select("row_id", "case_id"), c.filter("band is not null").select("case_id", F.col("band").alias("first_band")), "case_id").select("row_id", "first_band", "n_labels")


@query("SELECT row_id FROM general_ledger ORDER BY md5(row_id::VARCHAR || ':42'), row_id LIMIT 500")
def sampled_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sampled(gl_of(spark, d).select("row_id"), "row_id", 500)


# ---- sinks
@query("""
    WITH u AS (SELECT DISTINCT upload_batch_id AS l FROM general_ledger WHERE upload_batch_id IS NOT NULL ORDER BY 1), e AS (SELECT min(l) AS a, max(l) AS z FROM u)
    SELECT upload_batch_id, count(*) AS line_count, count(DISTINCT document_id) AS documents FROM general_ledger, e WHERE upload_batch_id IS NOT NULL AND upload_batch_id <> e.a AND (upload_batch_id <> e.z OR debit_amount > 0) GROUP BY 1""")
def stored_loads(spark: SparkSession, d: str) -> DataFrame:
    """All loads stored as partitions; the last stored again with fewer rows, the first dropped; then what is there."""
    at = new_path(spark, "loads")
    gl = gl_of(spark, d).filter("upload_batch_id is not null").select("row_id", "document_id", "debit_amount", "upload_batch_id")
    e = gl.agg(F.min("upload_batch_id").alias("a"), F.max("upload_batch_id").alias("z")).first()
    sinks.save_load(gl, at)
    sinks.save_load(gl.filter((F.col("upload_batch_id") == e["z"]) & (F.col("debit_amount") > 0)), at)
    sinks.drop_load(spark, at, e["a"])
    return sinks.list_batches(spark, at)


@query("SELECT row_id, document_id FROM general_ledger WHERE upload_batch_id = (SELECT max(upload_batch_id) FROM general_ledger)")
def restored_load(spark: SparkSession, d: str) -> DataFrame:
    at = new_path(spark, "loads")
    gl = gl_of(spark, d).filter("upload_batch_id is not null").select("row_id", "document_id", "upload_batch_id")
    sinks.save_load(gl, at)
    return sinks.load_batch(spark, at, gl.agg(F.max("upload_batch_id")).first()[0]).select("row_id", "document_id")


@query("""
    WITH c AS (SELECT case_id, theme_id, row_id FROM contract_v2_group_top_case_eval WHERE case_id IS NOT NULL), a AS (SELECT case_id, min((row_id % 2) * 1000000000000 + row_id) AS k FROM c GROUP BY 1)
    SELECT case_id, k % 1000000000000 AS row_id FROM a""")
def appended_once(spark: SparkSession, d: str) -> DataFrame:
    """Rows with even numbers appended by case, then those with odd ones: cases that are there keep their row."""
    at = new_path(spark, "cases")
    c = read(spark, d, "contract_v2_group_top_case_eval").filter("case_id is not null").select("row_id", "case_id")
    sinks.append_new(c.filter("row_id % 2 = 0"), at, "case_id")
    sinks.append_new(c.filter("row_id % 2 = 1"), at, "case_id")
    return spark.read.parquet(at).select("case_id", "row_id")


_EVENTS = "e AS (SELECT case_id, row_id, band, evaluated_at FROM contract_v2_group_top_case_eval WHERE case_id IS NOT NULL)"


@query(f"""
    WITH {_EVENTS}, w AS (SELECT * FROM e UNION ALL SELECT case_id, 100000000 + row_id, band, TIMESTAMP '2100-01-01' FROM e WHERE band IS NULL OR row_id % 7 = 0),
    l AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY evaluated_at NULLS FIRST, row_id) AS k, count(*) OVER (PARTITION BY case_id) AS n FROM w)
    SELECT case_id, row_id, band FROM l WHERE k = n AND row_id < 100000000""")
def log_state(spark: SparkSession, d: str) -> DataFrame:
    """A whitelist kept as a log: cases put on it with each evaluation, some taken off again; what is on it now."""
    log = sinks.Log(spark, new_path(spark, "whitelist"))
    e = read(spark, d, "contract_v2_group_top_case_eval").filter("case_id is not null").select("case_id", "row_id", "band", "evaluated_at")
    log.append(e)
    log.append(e.filter("band is null or row_id % 7 = 0").withColumns({"row_id": F.col("row_id") + 100_000_000, "evaluated_at": F.expr("timestamp_ntz'2100-01-01 00:00:00'")}), deleted=True)
    return log.current("case_id", ["evaluated_at", "row_id"]).select("case_id", "row_id", "band")


@query("SELECT case_id, row_id, band FROM contract_v2_group_top_case_eval WHERE theme_id = (SELECT min(theme_id) FROM contract_v2_group_top_case_eval)")
def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """An audit trail appended in two steps and read for one theme."""
    log = sinks.Log(spark, new_path(spark, "trail"))
    e = read(spark, d, "contract_v2_group_top_case_eval").select("case_id", "row_id", "band", "theme_id")
    log.append(e.filter("row_id % 2 = 0"))
    log.append(e.filter("row_id % 2 = 1"))
    return log.all(theme_id=e.agg(F.min("theme_id")).first()[0]).select("case_id", "row_id", "band")


@query("""SELECT employee_id, substring(display_name, 1, 2) || repeat('*', greatest(length(display_name) - 2, 0)) AS display_name, substring(sha256('salt' || user_id), 1, 16) AS user_id FROM employees""")
def masked_employees(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "employees").select("employee_id", sinks.masked(F.col("display_name")).alias("display_name"), sinks.hashed(F.col("user_id"), "salt").alias("user_id"))


@query("""SELECT row_id, 'case_' || substring(sha256(concat_ws(chr(31), coalesce('v' || theme_id, 'n'), coalesce('v' || case_id, 'n'))), 1, 16) AS content_id FROM contract_v2_group_top_case_eval""")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contract_v2_group_top_case_eval").select("row_id", sinks.content_id("case_", "theme_id", "case_id").alias("content_id"))


@query(f"""
    WITH dd AS (SELECT document_id, sum(coalesce(debit_amount, 0.0)) AS a FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1)
    SELECT document_id, round(a, 2) AS amount, ({" + ".join(f"(a >= {x})::INTEGER" for x in S.approval_ladder)})::INTEGER AS level FROM dd""")
def approval_levels(spark: SparkSession, d: str) -> DataFrame:
    g = gl_of(spark, d).filter("document_id is not null").groupBy("document_id").agg(F.sum(F.coalesce("debit_amount", F.lit(0.0))).alias("a"))
    return g.select("document_id", F.round("a", 2).alias("amount"), sinks.approval_level(F.col("a"), S.approval_ladder).alias("level"))


@query("SELECT row_id FROM general_ledger WHERE company_code IN ('C0001', 'C0002') AND posting_date >= TIMESTAMP '2023-06-01' AND posting_date < TIMESTAMP '2024-02-01' AND greatest(coalesce(debit_amount, 0), coalesce(credit_amount, 0)) >= 1000")
def filtered_lines(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    return gl_of(spark, d).filter(where(companies=["C0001", "C0002"], since=datetime.datetime(2023, 6, 1), until=datetime.datetime(2024, 2, 1), least=1000.0)).select("row_id")


@query(ledger._SQL["feature_amount"])
def cached_features(spark: SparkSession, d: str) -> DataFrame:
    """The amount columns from a table kept under a fingerprint of the ledger's files."""
    x = cached(spark, "amounts", [f"{d}/general_ledger.parquet"], lambda: X.amount_features(gl_of(spark, d).select("row_id", "debit_amount", "credit_amount")))
    return x.select("row_id", "base_amount", F.round("amount_magnitude", 6).alias("amount_magnitude"), "is_round_number", F.col("first_digit").cast("double").alias("first_digit"))


@query("SELECT row_id, CASE WHEN ('0x' || substring(md5(coalesce(document_id, '') || ':42'), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM general_ledger")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return L.group_split(gl_of(spark, d), "document_id").select("row_id", "split")


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
