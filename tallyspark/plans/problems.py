"""Queries of the general data-pipeline operators, with their SQL equivalents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, parse, profile, skew
from ..session import at_once, code_mark, new_path, read, shared_dir, written

#: Columns of general_ledger that are profiled: all but the row's own identifier and the load itself.
PROFILED = [
    "document_id", "company_code", "fiscal_year", "fiscal_period", "posting_date", "document_date", "document_type", "currency", "exchange_rate", "reference", "header_text", "created_by",
    "user_persona", "source", "business_process", "approved_by", "approval_date", "line_number", "gl_account", "debit_amount", "credit_amount", "local_amount", "cost_center", "line_text",
    "tax_code", "tax_amount", "trading_partner", "created_at",
]


def _ledger_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ledger and its value counts, from a store in the shared folder that is kept and brought up to date load by load."""
    gl = read(spark, d, "general_ledger")
    place = hashlib.sha256(f"{d}/general_ledger {code_mark()}".encode()).hexdigest()[:16]
    store = profile.ValueCountStore(spark, f"{shared_dir(spark)}/tallyspark/value-counts/general_ledger-{place}")
    return gl, store.sync(gl, "upload_batch_id", PROFILED).current()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    gl, counts = _ledger_counts(spark, d)
    return profile.check_catalog(counts, read(spark, d, "s0_column_catalog"), gl.select(*PROFILED).schema)


def _profile(counts: DataFrame) -> DataFrame:
    m = profile.metrics(counts).select(F.col("load_id").alias("upload_batch_id"), "column_name", "row_count", "nulls", "distinct_count", F.round("entropy", 6).alias("entropy"))
    return m.filter("upload_batch_id is not null")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(_ledger_counts(spark, d)[1])


def p2_retracted(spark: SparkSession, d: str) -> DataFrame:
    """The profile after signed deltas: all loads but the last are added, then the last one, the first is taken back, and the last, changed, is loaded again."""
    gl = read(spark, d, "general_ledger")
    ends = gl.agg(F.min("upload_batch_id").alias("a"), F.max("upload_batch_id").alias("z")).first()
    store = profile.ValueCountStore(spark, new_path(spark, "value-counts"))
    last = F.coalesce(F.col("upload_batch_id") == ends["z"], F.lit(False))
    store.sync(gl.filter(~last), "upload_batch_id", PROFILED)
    store.sync(gl, "upload_batch_id", PROFILED)
    store.sync(gl.filter(F.coalesce(F.col("upload_batch_id") != ends["a"], F.lit(True))).withColumn("currency", F.when(~last, F.col("currency"))), "upload_batch_id", PROFILED)
    return _profile(store.current())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parse.errors(parse.parsed(read(spark, d, "journal_entries"), "record_id", "raw_line"))


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    p = parse.parsed(read(spark, d, "journal_entries"), "record_id", "raw_line")
    v = parse.valid_rows(p, written(parse.errors(p), "errors"))
    return v.select("record_id", "debit_amount", "credit_amount", "fiscal_period")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(read(spark, d, "general_ledger"), ["gl_account", "created_by"], 0.05)


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    gl = read(spark, d, "general_ledger")
    out = [skew.totals_by_key(gl, k, ["local_amount"]).select(F.lit(k).alias("field_name"), "key_value", "n_rows", F.round("sum_local_amount", 2).alias("total")) for k in ("gl_account", "created_by")]
    return out[0].unionByName(out[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = at_once(*((lambda r=r: orphans.orphans(read(spark, d, r.table), read(spark, d, r.parent), r)) for r in orphans.LEDGER_REFERENCES))
    return found[0].unionByName(found[1]).unionByName(found[2])


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.counts_per_period(p7_found(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_profile, p2_retracted, p4_found, p4_valid, p5_found, p5_totals, p7_found, p7_counts)}


_STRINGS = {"document_id", "company_code", "document_type", "currency", "reference", "header_text", "created_by", "user_persona", "source", "business_process", "approved_by", "gl_account", "cost_center", "line_text", "tax_code", "trading_partner"}
_DOUBLES = {"exchange_rate", "debit_amount", "credit_amount", "local_amount", "tax_amount"}
_INTS = {"fiscal_year", "fiscal_period", "line_number"}


def _counts_sql(table: str = "general_ledger") -> str:
    """(load_id, column_name, real, s, x, n) of every column."""
    real = lambda c: "object" if c in _STRINGS else "float64" if c in _DOUBLES else "int64" if c in _INTS else "datetime64[us]"
    num = lambda c: f"{c}::DOUBLE" if c in _DOUBLES | _INTS else "NULL::DOUBLE"
    return " UNION ALL ".join(f"SELECT upload_batch_id AS load_id, '{c}' AS column_name, '{real(c)}' AS real, {c}::VARCHAR AS s, {num(c)} AS x, count(*) AS n FROM {table} GROUP BY ALL" for c in PROFILED)


_P2 = f"""
    WITH c AS ({_counts_sql()}),
    m AS (SELECT load_id, column_name, any_value(real) AS real, sum(n) AS rows_, sum(CASE WHEN s IS NULL THEN n ELSE 0 END) AS nulls, count(s) AS dist, min(x) AS lo, max(x) AS hi,
          sum(CASE WHEN s IS NULL THEN n ELSE 0 END) / sum(n) AS nr FROM c GROUP BY 1, 2),
    mv AS (SELECT load_id, column_name, abs(x) AS v, sum(sum(n)) OVER (PARTITION BY load_id, column_name ORDER BY abs(x)) AS upto, sum(sum(n)) OVER (PARTITION BY load_id, column_name) AS total
           FROM c WHERE real = 'float64' AND x IS NOT NULL AND x <> 0 AND NOT isnan(x) GROUP BY 1, 2, 3),
    med AS (SELECT load_id, column_name, min(v) AS med FROM mv WHERE upto >= (total + 1) // 2 GROUP BY 1, 2),
    k AS (SELECT a.*, b.upload_batch_id AS prev FROM s0_column_catalog a LEFT JOIN (SELECT DISTINCT engagement_id, load_no, upload_batch_id FROM s0_column_catalog) b
          ON a.engagement_id = b.engagement_id AND b.load_no = a.load_no - 1),
    bad AS (SELECT k.upload_batch_id, k.column_name, sum(n) AS bad FROM k JOIN c ON c.load_id = k.upload_batch_id AND c.column_name = k.column_name
            WHERE real = 'object' AND s IS NOT NULL AND value_pattern IS NOT NULL AND NOT regexp_matches(s, value_pattern) GROUP BY 1, 2),
    new AS (SELECT k.upload_batch_id, k.column_name, sum(n) AS new FROM k JOIN m pm ON pm.load_id = k.prev AND pm.column_name = k.column_name AND pm.dist <= 50
            JOIN c ON c.load_id = k.upload_batch_id AND c.column_name = k.column_name
            WHERE c.real = 'object' AND c.s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.load_id = k.prev AND o.column_name = k.column_name AND o.s = c.s) GROUP BY 1, 2),
    j AS (SELECT k.upload_batch_id, k.column_name, k.dtype, k.null_rate, k.distinct_count, k.min_value, k.max_value, m.*, p.nr AS p_nr, md.med, pd.med AS p_med, bad.bad, new.new
          FROM k JOIN m ON m.load_id = k.upload_batch_id AND m.column_name = k.column_name LEFT JOIN m p ON p.load_id = k.prev AND p.column_name = k.column_name
          LEFT JOIN med md ON md.load_id = k.upload_batch_id AND md.column_name = k.column_name LEFT JOIN med pd ON pd.load_id = k.prev AND pd.column_name = k.column_name
          LEFT JOIN bad ON bad.upload_batch_id = k.upload_batch_id AND bad.column_name = k.column_name LEFT JOIN new ON new.upload_batch_id = k.upload_batch_id AND new.column_name = k.column_name)
    SELECT upload_batch_id, column_name, 'dtype' AS measure FROM j WHERE dtype <> real
    UNION ALL SELECT upload_batch_id, column_name, 'null_rate' FROM j WHERE abs(null_rate - nr) > 0.01
    UNION ALL SELECT upload_batch_id, column_name, 'distinct_count' FROM j WHERE abs(distinct_count - dist) > 0.05 * dist
    UNION ALL SELECT upload_batch_id, column_name, 'pattern' FROM j WHERE bad > 0.02 * (rows_ - nulls)
    UNION ALL SELECT upload_batch_id, column_name, 'range' FROM j WHERE lo < min_value OR hi > max_value
    UNION ALL SELECT upload_batch_id, column_name, 'null_shift' FROM j WHERE abs(nr - p_nr) > 0.1
    UNION ALL SELECT upload_batch_id, column_name, 'median_shift' FROM j WHERE med IS NOT NULL AND p_med IS NOT NULL AND greatest(med, p_med) > 5 * least(med, p_med)
    UNION ALL SELECT upload_batch_id, column_name, 'domain_shift' FROM j WHERE new > 0.2 * (rows_ - nulls)"""

_NUM = "([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)?"
_FIELD = '("([^"]|"")*"|[^",]*)'
_P4 = f"""
    r AS (SELECT record_id, raw_line, regexp_full_match(raw_line, '{_FIELD}(,{_FIELD})*') AS well FROM journal_entries),
    f AS (SELECT record_id, list_transform(regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1),
                 lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS c FROM r WHERE well),
    e AS (SELECT record_id, 'column_count' AS reason FROM r WHERE raw_line IS NULL OR NOT regexp_matches(raw_line, '\\S')
          UNION ALL SELECT record_id, 'quoting' FROM r WHERE NOT well AND regexp_matches(raw_line, '\\S')
          UNION ALL SELECT record_id, 'column_count' FROM f JOIN r USING (record_id) WHERE len(c) <> 11 AND regexp_matches(raw_line, '\\S')
          UNION ALL SELECT record_id, 'fiscal_period' FROM f WHERE len(c) = 11 AND NOT regexp_full_match(c[4], '0*([1-9]|1[0-6])')
          UNION ALL SELECT record_id, 'posting_date' FROM f WHERE len(c) = 11 AND (NOT regexp_full_match(c[5], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?')
                    OR try_strptime(c[5], ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d']) IS NULL OR c[5] < '1900')
          UNION ALL SELECT record_id, 'debit_amount' FROM f WHERE len(c) = 11 AND NOT regexp_full_match(c[9], '([+\\-−]?{_NUM}|\\({_NUM}\\))?')
          UNION ALL SELECT record_id, 'credit_amount' FROM f WHERE len(c) = 11 AND NOT regexp_full_match(c[10], '([+\\-−]?{_NUM}|\\({_NUM}\\))?'))"""


def _amount_sql(c: str) -> str:
    return f"TRY_CAST(replace(regexp_replace({c}, '[,()+]', '', 'g'), '−', '-') AS DOUBLE) * (CASE WHEN starts_with({c}, '(') THEN -1 ELSE 1 END)"


def _orphans_sql(r: orphans.Reference, status: str) -> str:
    k = "nullif(lower(regexp_replace({}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')), '')"
    return f"""
        SELECT '{r.table}' AS table_name, coalesce(strftime(c.{r.period}, '%Y-%m'), 'unknown') AS ref_period, c.{r.row_id} AS row_id,
               CASE WHEN p.alive IS NULL THEN 'missing' WHEN p.alive = 0 THEN 'deleted' ELSE 'late' END AS reason
        FROM {r.table} c LEFT JOIN (
            SELECT {k.format(r.parent_key)} AS key, sum(CASE WHEN {status} THEN 0 ELSE 1 END) AS alive, sum(CASE WHEN NOT {status} AND created_at IS NULL THEN 1 ELSE 0 END) AS undated,
                   min(CASE WHEN NOT {status} THEN created_at END) AS first FROM {r.parent} GROUP BY 1) p ON p.key = {k.format("c." + r.key)}
        WHERE {k.format("c." + r.key)} IS NOT NULL AND (p.alive IS NULL OR p.alive = 0 OR (p.undated = 0 AND c.{r.created} < p.first))"""


_P7 = " UNION ALL ".join(_orphans_sql(r, "coalesce(lower(regexp_replace(status, '\\s+', '', 'g')) = 'deleted', false)") for r in orphans.LEDGER_REFERENCES)


def oracle_sql() -> dict[str, str]:
    both = ("gl_account", "created_by")
    profiled = lambda with_, table: f"""WITH {with_} c AS ({_counts_sql(table)}), m AS (SELECT load_id, column_name, sum(n)::BIGINT AS row_count, sum(CASE WHEN s IS NULL THEN n ELSE 0 END)::BIGINT AS nulls, count(s) AS distinct_count,
                          sum(CASE WHEN s IS NOT NULL THEN n * log2(n) END) AS nl FROM c WHERE load_id IS NOT NULL GROUP BY 1, 2)
                          SELECT load_id AS upload_batch_id, column_name, row_count, nulls, distinct_count, CASE WHEN row_count > nulls THEN round(log2(row_count - nulls) - nl / (row_count - nulls), 6) END AS entropy FROM m"""  # noqa: E731
    left = """g AS (SELECT * REPLACE (CASE WHEN upload_batch_id IS DISTINCT FROM (SELECT max(upload_batch_id) FROM general_ledger) THEN currency END AS currency) FROM general_ledger
              WHERE upload_batch_id IS DISTINCT FROM (SELECT min(upload_batch_id) FROM general_ledger)),"""
    return {
        "p2_found": _P2, "p2_profile": profiled("", "general_ledger"), "p2_retracted": profiled(left, "g"),
        "p4_found": f"WITH {_P4} SELECT record_id, reason FROM e",
        "p4_valid": f"WITH {_P4} SELECT record_id, {_amount_sql('c[9]')} AS debit_amount, {_amount_sql('c[10]')} AS credit_amount, c[4]::INTEGER AS fiscal_period FROM f WHERE record_id NOT IN (SELECT record_id FROM e)",
        "p5_found": " UNION ALL ".join(f"SELECT '{k}' AS field_name, {k} AS key_value FROM general_ledger WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) >= 0.05 * (SELECT count(*) FROM general_ledger)" for k in both),
        "p5_totals": " UNION ALL ".join(f"SELECT '{k}' AS field_name, {k} AS key_value, count(*) AS n_rows, round(sum(local_amount), 2) AS total FROM general_ledger WHERE {k} IS NOT NULL GROUP BY {k}" for k in both),
        "p7_found": _P7,
        "p7_counts": f"WITH f AS ({_P7}) SELECT table_name, ref_period, reason, count(*) AS n_rows FROM f GROUP BY 1, 2, 3",
    }
