"""Feature, validation and test queries over the ledger, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as S
from ..operators import features as X
from ..operators import rules as R
from ..operators import validate as V
from ..session import read, spread

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def gl_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "general_ledger")


# SQL shared by the equivalents
Z = lambda c: f"coalesce({c}::DOUBLE, 0.0)"
D, C = Z("debit_amount"), Z("credit_amount")
BASE = f"greatest({D}, {C})"
BLANK = lambda c: f"({c} IS NULL OR trim({c}::VARCHAR, ' ') = '')"
PLAIN = lambda c: f"lower(trim({c}, ' '))"
_SOURCES = lambda x: ", ".join(f"'{v}'" for v in x)
H = "(hour(posting_date) + minute(posting_date) / 60.0)"
WEEKEND = "coalesce(isodow(posting_date) >= 6, false)"
HOLIDAY = f"coalesce(month(posting_date) * 100 + day(posting_date) IN ({', '.join(str(m * 100 + x) for m, x in S.fixed_holidays)}) OR strftime(posting_date, '%Y-%m-%d') IN ({', '.join(repr(x) for x in S.moving_holidays)}), false)"
TIMED = "(SELECT coalesce(bool_or(hour(posting_date) * 3600 + minute(posting_date) * 60 + second(posting_date) > 0), false) FROM general_ledger)"
LATE = f"coalesce({TIMED} AND ({H} >= 22 OR {H} < 6), false)"
END = "coalesce(date_diff('day', posting_date::DATE, last_day(posting_date::DATE)) <= 5 OR day(posting_date) <= 5, false)"
BACK = "floor(date_diff('second', document_date, posting_date) / 86400.0)"
MD = "(month(posting_date) * 100 + day(posting_date))"
KIND0 = f"CASE WHEN posting_date IS NULL THEN 'unknown' WHEN {H} >= 22 OR {H} < 6 THEN 'midnight' WHEN {H} >= 8.5 AND {H} < 18.5 THEN 'normal' ELSE 'overtime' END"
STARTS = lambda c, ps: "coalesce(" + " OR ".join(f"starts_with({c}, '{p}')" for p in ps) + ", false)"
HUMAN = f"(NOT coalesce({PLAIN('user_persona')} = 'automated_system', false) AND NOT coalesce({PLAIN('source')} IN ({_SOURCES(S.automated_sources)}), false) AND NOT coalesce(contains(upper(created_by), 'SVC_'), false) AND NOT {BLANK('created_by')})"


@query(f"""
    WITH t AS (SELECT row_id, {WEEKEND} AS is_weekend, {HOLIDAY} AS is_holiday, {LATE} AS is_after_hours, {END} AS is_period_end, {BACK} AS days_backdated,
        (fiscal_period <> month(posting_date))::INTEGER::DOUBLE AS fiscal_period_mismatch, {KIND0} AS k, {MD} AS md FROM general_ledger),
    u AS (SELECT *, CASE WHEN k = 'overtime' AND (md >= 1220 OR md <= 115) THEN 'normal' ELSE k END AS k2 FROM t)
    SELECT row_id, is_weekend, is_holiday, is_after_hours, is_period_end, days_backdated, fiscal_period_mismatch,
        CASE WHEN k2 = 'normal' AND (is_weekend OR is_holiday) THEN 'overtime' ELSE k2 END AS time_zone_category FROM u""")
def feature_time(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    x = X.time_features(spread(gl.select("row_id", "posting_date", "document_date", "fiscal_period")), timed=X.has_times(gl))
    return x.select("row_id", "is_weekend", "is_holiday", "is_after_hours", "is_period_end", F.col("days_backdated").cast("double").alias("days_backdated"), F.col("fiscal_period_mismatch").cast("int").cast("double").alias("fiscal_period_mismatch"), "time_zone_category")


_ROUND = "(b > 0 AND abs(b - round_even(b, 0)) < 1e-9 AND length(round_even(b, 0)::DECIMAL(20,0)::VARCHAR) >= 3 AND length(rtrim(round_even(b, 0)::DECIMAL(20,0)::VARCHAR, '0')) <= 2)"
_DIGIT = "try_cast(regexp_extract(m::DECIMAL(30,6)::VARCHAR, '([1-9])', 1) AS INTEGER)"


@query(f"""
    WITH t AS (SELECT row_id, {BASE} AS b, greatest(abs({D}), abs({C})) AS m FROM general_ledger)
    SELECT row_id, b AS base_amount, round(log10(abs(b) + 1), 6) AS amount_magnitude, {_ROUND} AS is_round_number, {_DIGIT}::DOUBLE AS first_digit FROM t""")
def feature_amount(spark: SparkSession, d: str) -> DataFrame:
    x = X.amount_features(spread(gl_of(spark, d).select("row_id", "debit_amount", "credit_amount")))
    return x.select("row_id", "base_amount", F.round("amount_magnitude", 6).alias("amount_magnitude"), "is_round_number", F.col("first_digit").cast("double").alias("first_digit"))


def _z_sql(value: str) -> str:
    return f"""
    WITH t AS (SELECT row_id, gl_account, {value} AS v, coalesce(gl_account, '') AS a, coalesce(substring(gl_account, 1, 1), '') AS c, {BASE} AS b FROM general_ledger),
    s AS (SELECT *, count(*) OVER (PARTITION BY a) AS an, avg(v) OVER (PARTITION BY a) AS am, coalesce(stddev_samp(v) OVER (PARTITION BY a), 0) AS sa,
        count(*) OVER (PARTITION BY c) AS cn, avg(v) OVER (PARTITION BY c) AS cm, coalesce(stddev_samp(v) OVER (PARTITION BY c), 0) AS sc,
        count(*) OVER () AS gn, avg(v) OVER () AS gm, coalesce(stddev_samp(v) OVER (), 0) AS sg FROM t),
    p AS (SELECT *, CASE WHEN an >= 30 THEN am WHEN cn >= 30 THEN cm ELSE gm END AS m, CASE WHEN an >= 30 THEN sa WHEN cn >= 30 THEN sc ELSE sg END AS sd FROM s),
    z AS (SELECT *, CASE WHEN gn < 10 OR v IS NULL THEN NULL WHEN sd = 0 THEN 0.0 ELSE (v - m) / sd END AS z FROM p)"""


@query(_z_sql(BASE) + " SELECT row_id, round(z, 4) + 0.0 AS amount_zscore FROM z")
def feature_zscore(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import base_amount

    return X.zscores(spread(gl_of(spark, d).select("row_id", "gl_account", "debit_amount", "credit_amount")), base_amount(), "amount_zscore").select("row_id", (F.round("amount_zscore", 4) + 0.0).alias("amount_zscore"))


@query(f"""
    SELECT row_id, coalesce({PLAIN("source")} IN ({_SOURCES(S.manual_sources)}), false) AS is_manual_je,
        coalesce({PLAIN("business_process")} = 'intercompany', false) OR coalesce({PLAIN("document_type")} = 'ic', false) AS is_intercompany,
        {STARTS("gl_account", S.revenue_prefixes)} AS is_revenue_account,
        coalesce(regexp_matches(line_text, '(?i)({"|".join(S.suspense_words)})'), false) OR {STARTS("gl_account", S.suspense_prefixes)} AS is_suspense_account FROM general_ledger""")
def feature_pattern(spark: SparkSession, d: str) -> DataFrame:
    return X.pattern_features(gl_of(spark, d)).select("row_id", "is_manual_je", "is_intercompany", "is_revenue_account", "is_suspense_account")


@query(rf"""
    WITH t AS (SELECT row_id, line_text, trim(regexp_replace(lower(line_text), '[ \t\r\n]+', ' ', 'g'), ' ') AS c FROM general_ledger),
    u AS (SELECT *, string_split(c, ' ') AS k FROM t)
    SELECT row_id, CASE WHEN {BLANK("line_text")} THEN 'missing' WHEN regexp_matches(c, '^[ㄱ-ㅎㅏ-ㅣ ]+$') OR regexp_matches(c, '^[^0-9a-z가-힣]+$') OR (length(c) >= 4 AND c = repeat(substring(c, 1, 1), length(c))) THEN 'corrupted' ELSE 'normal' END AS description_quality,
        (CASE WHEN {BLANK("line_text")} THEN 0 ELSE len(k) END)::INTEGER AS token_count, round(CASE WHEN {BLANK("line_text")} THEN 0.0 ELSE len(list_distinct(k)) / len(k) END, 6) AS type_token_ratio,
        round(CASE WHEN c IS NULL THEN NULL WHEN c = '' THEN 0.0 ELSE list_aggregate(string_split(c, ''), 'entropy') END, 5) AS char_entropy,
        CASE WHEN regexp_matches(c, '({"|".join(S.high_words)})') THEN 'high' WHEN regexp_matches(c, '({"|".join(S.medium_words)})') THEN 'medium' END AS risk_keyword FROM u""")
def feature_text(spark: SparkSession, d: str) -> DataFrame:
    x = X.text_features(spread(gl_of(spark, d).select("row_id", "line_text")))
    return x.select("row_id", "description_quality", "token_count", F.round("type_token_ratio", 6).alias("type_token_ratio"), F.round("char_entropy", 5).alias("char_entropy"), "risk_keyword")


_APPROVAL = f"""
    WITH m AS (SELECT {PLAIN("user_id")} AS u, max(approval_limit) AS lim, bool_or(can_approve_je) AS may FROM employees WHERE user_id IS NOT NULL GROUP BY 1),
    dd AS (SELECT document_id, sum({D}) AS amt FROM general_ledger GROUP BY 1),
    a AS (SELECT g.row_id, dd.amt, CASE WHEN may = false THEN 0.0 ELSE lim END AS lim, (may IS NOT NULL OR lim IS NOT NULL) AS known
        FROM general_ledger g LEFT JOIN m ON {PLAIN("g.approved_by")} = m.u LEFT JOIN dd ON g.document_id = dd.document_id)"""


@query(_APPROVAL + " SELECT row_id, round(amt, 2) AS document_amount, lim AS approver_limit, known AS approver_known, coalesce(amt >= lim * 0.9 AND amt < lim, false) AS is_near_threshold, coalesce(amt > lim, false) AS exceeds_threshold FROM a")
def feature_approval(spark: SparkSession, d: str) -> DataFrame:
    x = X.approval_features(gl_of(spark, d), read(spark, d, "employees"))
    return x.select("row_id", F.round("document_amount", 2).alias("document_amount"), "approver_limit", "approver_known", "is_near_threshold", "exceeds_threshold")


@query(f"""
    WITH c AS (SELECT {", ".join(f"count(*) FILTER (WHERE {BLANK(c)}) AS {c}_missing" for c in R.REQUIRED)}, count(*) FILTER (WHERE NOT fiscal_period BETWEEN 1 AND 16) AS period_out_of_range,
        count(*) FILTER (WHERE debit_amount < 0) AS negative_debit, count(*) FILTER (WHERE credit_amount < 0) AS negative_credit, count(*) FILTER (WHERE {D} > 0 AND {C} > 0) AS both_sides,
        count(*) FILTER (WHERE NOT regexp_full_match(gl_account, '[0-9]{{6}}')) AS account_format FROM general_ledger)
    UNPIVOT c ON COLUMNS(*) INTO NAME check_name VALUE failures""")
def validate_schema(spark: SparkSession, d: str) -> DataFrame:
    return V.schema_report(gl_of(spark, d))


@query(f"""
    WITH g AS (SELECT document_id, round(sum({D}), 2) AS debit, round(sum({C}), 2) AS credit FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1)
    SELECT document_id, debit, credit, round(debit - credit, 2) AS difference FROM g WHERE abs(round(debit - credit, 2)) >= 0.01""")
def validate_balance(spark: SparkSession, d: str) -> DataFrame:
    return V.balances(gl_of(spark, d))


@query(f"""
    WITH p AS (SELECT document_id, sum({D}) AS d, sum({C}) AS c FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1),
    g AS (SELECT count(*) AS documents, count(*) FILTER (WHERE abs(d - c) >= 0.01) AS unbalanced, sum(d) AS d, sum(c) AS c FROM p)
    SELECT documents, unbalanced, round(abs(d - c) / greatest(d, c, 1.0), 6) AS difference_ratio, abs(d - c) / greatest(d, c, 1.0) <= 0.01 AND unbalanced / greatest(documents, 1) <= 0.1 AS may_load FROM g""")
def validate_gate(spark: SparkSession, d: str) -> DataFrame:
    return V.gate(gl_of(spark, d))


@query("""
    WITH b AS (SELECT min(posting_date::DATE) AS lo, max(posting_date::DATE) AS hi FROM general_ledger), s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b)
    SELECT strftime(day, '%Y-%m-%d') AS day FROM s WHERE isodow(day) < 6 AND day NOT IN (SELECT posting_date::DATE FROM general_ledger WHERE posting_date IS NOT NULL)""")
def validate_business_days(spark: SparkSession, d: str) -> DataFrame:
    return V.missing_business_days(gl_of(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""
    WITH g AS (SELECT count(*) AS n FROM general_ledger GROUP BY ALL), c AS (SELECT * EXCLUDE (row_id, upload_batch_id) FROM general_ledger)
    SELECT (SELECT count(*) FROM c) AS "rows", (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS repeated""")
def validate_repeats(spark: SparkSession, d: str) -> DataFrame:
    return V.repeated_rows(gl_of(spark, d), ["row_id", "upload_batch_id"])


@query(f"""
    WITH m AS (SELECT strftime(posting_date, '%Y-%m') AS month, count(*) AS lines, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY 1)
    SELECT month, lines, amount, round(amount / lag(amount) OVER (ORDER BY month) - 1, 6) AS change, round((amount - avg(amount) OVER ()) / stddev_samp(amount) OVER (), 6) AS z, round(amount / avg(amount) OVER (), 6) AS seasonality FROM m""")
def validate_volatility(spark: SparkSession, d: str) -> DataFrame:
    v = V.volatility(gl_of(spark, d))
    return v.select("month", "lines", "amount", *(F.round(c, 6).alias(c) for c in ("change", "z", "seasonality")))


@query(f"""
    WITH x AS (SELECT company_code, gl_account, {BASE} AS v FROM general_ledger WHERE {BASE} > 0),
    g AS (SELECT company_code, count(*) AS n, stddev_samp(v) / avg(v) AS cv, skewness(v) AS skew, kurtosis(v) AS kurt FROM x GROUP BY 1),
    a AS (SELECT company_code, gl_account, sum(v) AS a FROM x GROUP BY 1, 2), h AS (SELECT company_code, sum(a * a) / pow(sum(a), 2) AS hhi FROM a GROUP BY 1)
    SELECT company_code, n, round(cv, 4) AS cv, round(skew, 3) AS skew, round(kurt, 2) AS kurt, round(hhi, 6) AS hhi FROM g JOIN h USING (company_code)""")
def validate_dispersion(spark: SparkSession, d: str) -> DataFrame:
    v = V.dispersion(gl_of(spark, d))
    return v.select("company_code", "n", F.round("cv", 4).alias("cv"), F.round("skew", 3).alias("skew"), F.round("kurt", 2).alias("kurt"), F.round("hhi", 6).alias("hhi"))


@query(f"""
    SELECT month(posting_date)::INTEGER AS month, round(sum({BASE}) FILTER (WHERE fiscal_year = 2023), 2) AS y2023, round(sum({BASE}) FILTER (WHERE fiscal_year = 2024), 2) AS y2024 FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY 1""")
def validate_yearly_pivot(spark: SparkSession, d: str) -> DataFrame:
    return V.yearly_pivot(gl_of(spark, d), [2023, 2024])


_TB = f"""tb AS (SELECT company_code, gl_account, fiscal_year, fiscal_period, round(sum({D}), 2) AS debit, round(sum({C}), 2) AS credit, round(round(sum({D}), 2) - round(sum({C}), 2), 2) AS net
    FROM general_ledger WHERE NOT {BLANK("gl_account")} GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_TB} SELECT * REPLACE (fiscal_year::VARCHAR AS fiscal_year, fiscal_period::VARCHAR AS fiscal_period) FROM tb")
def trial_balance(spark: SparkSession, d: str) -> DataFrame:
    return V.trial_balance(gl_of(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("fiscal_year", "fiscal_period")})


@query(f"""
    WITH {_TB}, a AS (SELECT substring(gl_account, 1, 2) AS prefix, round(sum(net), 2) AS tb_net FROM tb GROUP BY 1),
    b AS (SELECT substring(gl_account, 1, 2) AS prefix, round(sum(local_amount), 2) AS gl_net FROM general_ledger WHERE NOT {BLANK("gl_account")} GROUP BY 1)
    SELECT prefix, tb_net, gl_net, round(coalesce(tb_net, 0) - coalesce(gl_net, 0), 2) AS difference FROM a FULL JOIN b USING (prefix)""")
def trial_balance_reconciled(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    return V.reconcile(V.trial_balance(gl), gl)


_NUMERIC = ["debit_amount", "credit_amount", "local_amount", "tax_amount", "exchange_rate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives, round(avg({c}), 3) AS avg, round(stddev_samp({c}), 2) AS sd, min({c}) AS lo, max({c}) AS hi, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75 FROM general_ledger" for c in _NUMERIC))
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    v = V.numeric_profile(gl_of(spark, d), _NUMERIC)
    return v.withColumns({"avg": F.round("avg", 3), "sd": F.round("sd", 2)} | {c: F.round(c, 4) for c in ("p25", "p50", "p75")})


_CATEGORICAL = ["document_type", "currency", "user_persona", "source", "business_process"]


@query(" UNION ALL ".join(f"(SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM general_ledger WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 5)" for c in _CATEGORICAL))
def profile_categorical(spark: SparkSession, d: str) -> DataFrame:
    return V.top_values(gl_of(spark, d), _CATEGORICAL)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS first, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT {c}::DATE) AS days, round(avg((isodow({c}) >= 6)::INTEGER), 6) AS weekend_share FROM general_ledger" for c in ("posting_date", "document_date", "approval_date", "created_at")))
def profile_datetime(spark: SparkSession, d: str) -> DataFrame:
    v = V.datetime_profile(gl_of(spark, d), ["posting_date", "document_date", "approval_date", "created_at"])
    return v.withColumn("weekend_share", F.round("weekend_share", 6))


@query("SELECT 'can_approve_je' AS column_name, count(*) FILTER (WHERE can_approve_je) AS trues, count(*) FILTER (WHERE NOT can_approve_je) AS falses, count(*) FILTER (WHERE can_approve_je IS NULL) AS nulls FROM employees")
def profile_boolean(spark: SparkSession, d: str) -> DataFrame:
    return V.boolean_profile(read(spark, d, "employees"), ["can_approve_je"])


# ---- tests of lines: (row_id, rule_id, score)
def _flag(rule: str, sql: str, score: str = "1.0") -> str:
    return f"SELECT row_id, '{rule}' AS rule_id, {score}::DOUBLE AS score {sql}"


SQL_FLAGS = {
    "L1-01": f"""SELECT row_id, 'L1-01' AS rule_id, 1.0::DOUBLE AS score FROM (SELECT row_id, sum({D} - {C}) OVER (PARTITION BY coalesce(document_id, '#' || row_id::VARCHAR)) AS off FROM general_ledger) WHERE abs(off) > 0.01""",
    "L1-02": _flag("L1-02", f"FROM general_ledger WHERE {' OR '.join(BLANK(c) for c in R.REQUIRED)}"),
    "L1-03": _flag("L1-03", f"FROM general_ledger WHERE NOT {BLANK('gl_account')} AND trim(gl_account, ' ') NOT IN (SELECT gl_account FROM general_ledger WHERE regexp_full_match(gl_account, '[0-9]{{6}}') GROUP BY 1 HAVING count(*) >= 10)"),
    "L1-04": _APPROVAL + " SELECT row_id, 'L1-04' AS rule_id, 1.0::DOUBLE AS score FROM a WHERE amt > lim",
    "L2-01": _APPROVAL + " SELECT row_id, 'L2-01' AS rule_id, 1.0::DOUBLE AS score FROM a WHERE amt >= lim * 0.9 AND amt < lim",
    "L1-05": _flag("L1-05", f"FROM general_ledger WHERE {PLAIN('created_by')} = {PLAIN('approved_by')} AND NOT {BLANK('created_by')} AND NOT coalesce({PLAIN('user_persona')} = 'automated_system', false)"),
    "L1-06": f"""WITH h AS (SELECT *, {PLAIN('created_by')} AS u FROM general_ledger WHERE {HUMAN}), p(a, b) AS (VALUES ('P2P', 'TRE'), ('O2C', 'TRE'), ('P2P', 'R2R')),
        w AS (SELECT DISTINCT h1.u, p.a, p.b FROM p JOIN (SELECT DISTINCT u, business_process AS bp FROM h) h1 ON h1.bp = p.a JOIN (SELECT DISTINCT u, business_process AS bp FROM h) h2 ON h2.bp = p.b AND h1.u = h2.u)
        SELECT row_id, 'L1-06' AS rule_id, 1.0::DOUBLE AS score FROM h WHERE EXISTS (SELECT 1 FROM w WHERE w.u = h.u AND (h.business_process = w.a OR h.business_process = w.b))""",
    "L1-07": _flag("L1-07", f"FROM general_ledger WHERE {BLANK('approved_by')}"),
    "L1-07-02": _flag("L1-07-02", f"FROM general_ledger WHERE NOT {BLANK('approved_by')} AND {PLAIN('approved_by')} NOT IN (SELECT {PLAIN('user_id')} FROM employees WHERE user_id IS NOT NULL)"),
    "L1-08": _flag("L1-08", "FROM general_ledger WHERE fiscal_period BETWEEN 1 AND 12 AND fiscal_period <> month(posting_date)"),
    "L2-02": f"""WITH dd AS (SELECT document_id, company_code, min(posting_date) AS at, max(document_type) AS ty, max(business_process) AS pr, max(trading_partner) AS pa, nullif(regexp_replace(upper(max(reference)), '[^0-9A-Z가-힣]', '', 'g'), '') AS ref,
            greatest(sum({D}), sum({C})) AS amt FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT * FROM dd WHERE pr = 'P2P' AND ty IN ('KZ', 'KR') AND NOT {BLANK('pa')} AND amt > 0),
        l AS (SELECT DISTINCT a.document_id FROM p a JOIN p b ON a.company_code = b.company_code AND a.pa = b.pa AND abs(a.amt - b.amt) <= greatest(least(a.amt * 0.02, 100000), 1)
            AND (b.at < a.at OR (b.at = a.at AND b.document_id < a.document_id)) AND (a.ref = b.ref OR (a.ref IS NULL AND b.ref IS NULL AND a.at::DATE - b.at::DATE <= 90)))
        SELECT row_id, 'L2-02' AS rule_id, 1.0::DOUBLE AS score FROM general_ledger WHERE document_id IN (SELECT document_id FROM l)""",
    "L2-03": f"""WITH x AS (SELECT *, {BASE} AS base, CASE WHEN {D} > 0 THEN 'D' ELSE 'C' END AS side, regexp_replace({PLAIN('line_text')}, '[^0-9a-z가-힣 ]', '', 'g') AS txt FROM general_ledger),
        y AS (SELECT * FROM x WHERE document_id IS NOT NULL AND posting_date IS NOT NULL AND base > 0 AND NOT {BLANK('trading_partner')} AND NOT {BLANK('txt')} AND gl_account IS NOT NULL)
        SELECT row_id, 'L2-03' AS rule_id, 1.0::DOUBLE AS score FROM (SELECT row_id, count(DISTINCT document_id) OVER (PARTITION BY gl_account, base, posting_date, side, trading_partner, txt) AS n FROM y) WHERE n >= 2""",
    "L2-04": f"""WITH g AS (SELECT document_id, sum(CASE WHEN {STARTS('gl_account', S.asset_prefixes)} THEN {D} ELSE 0 END) AS a, sum(CASE WHEN {STARTS('gl_account', S.expense_prefixes)} THEN {C} ELSE 0 END) AS e FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1)
        SELECT row_id, 'L2-04' AS rule_id, 1.0::DOUBLE AS score FROM general_ledger WHERE document_id IN (SELECT document_id FROM g WHERE a > 0 AND e > 0 AND abs(a - e) <= 0.02 * greatest(a, e))
        AND (({STARTS('gl_account', S.asset_prefixes)} AND {D} > 0) OR ({STARTS('gl_account', S.expense_prefixes)} AND {C} > 0))""",
    "L2-05": f"""WITH n AS (SELECT document_id, company_code, gl_account, sum({D} - {C}) AS net, min(posting_date)::DATE AS day FROM general_ledger WHERE document_id IS NOT NULL AND gl_account IS NOT NULL GROUP BY 1, 2, 3),
        c AS (SELECT *, round(abs(net) * 100)::BIGINT AS cents FROM n WHERE day IS NOT NULL), p AS (SELECT u.document_id AS a, v.document_id AS b, u.gl_account FROM c u JOIN c v ON u.company_code = v.company_code AND u.gl_account = v.gl_account AND u.cents = v.cents
            AND u.cents > 0 AND u.net > 0 AND v.net < 0 AND u.document_id <> v.document_id AND abs(u.day - v.day) <= 45),
        h AS (SELECT a AS document_id, gl_account FROM p UNION SELECT b, gl_account FROM p)
        SELECT row_id, 'L2-05' AS rule_id, 1.0::DOUBLE AS score FROM general_ledger g SEMI JOIN h ON g.document_id = h.document_id AND g.gl_account = h.gl_account""",
    "L3-02": _flag("L3-02", f"FROM general_ledger WHERE {PLAIN('source')} IN ({_SOURCES(S.manual_sources)})"),
    "L3-03": _flag("L3-03", f"FROM general_ledger WHERE {PLAIN('business_process')} = 'intercompany' OR {PLAIN('document_type')} = 'ic'"),
    "L3-04": _flag("L3-04", f"FROM general_ledger WHERE {END}"),
    "L3-05": _flag("L3-05", f"FROM general_ledger WHERE {WEEKEND} OR {HOLIDAY}"),
    "L3-06": _flag("L3-06", f"FROM general_ledger WHERE {LATE}"),
    "L3-07": _flag("L3-07", f"FROM general_ledger WHERE abs({BACK}) > 30"),
    "L3-09": _flag("L3-09", f"FROM general_ledger WHERE regexp_matches(line_text, '(?i)({'|'.join(S.suspense_words)})') OR {STARTS('gl_account', S.suspense_prefixes)}"),
    "L4-01": _z_sql(f"CASE WHEN {BASE} > 0 THEN ln({BASE}) END") + f" SELECT row_id, 'L4-01' AS rule_id, 1.0::DOUBLE AS score FROM z WHERE z > 3 AND {STARTS('gl_account', S.revenue_prefixes)}",
    "L4-03": f"""WITH g AS (SELECT company_code, fiscal_year, sum(CASE WHEN {STARTS('gl_account', S.revenue_prefixes)} THEN {C} - {D} ELSE 0 END) AS rev, sum(CASE WHEN {STARTS('gl_account', S.expense_prefixes)} THEN {D} - {C} ELSE 0 END) AS ex FROM general_ledger GROUP BY 1, 2),
        p AS (SELECT company_code, fiscal_year, greatest(abs(rev - ex) * 0.05 * 0.75, abs(rev) * 0.005 * 0.75) AS pm FROM g)
        SELECT row_id, 'L4-03' AS rule_id, 1.0::DOUBLE AS score FROM general_ledger JOIN p USING (company_code, fiscal_year) WHERE pm > 0 AND {BASE} >= pm""",
    "L4-04": f"""WITH x AS (SELECT DISTINCT document_id, gl_account AS a, {D} > 0 AS de, {C} > 0 AS cr FROM general_ledger WHERE document_id IS NOT NULL AND gl_account IS NOT NULL),
        p AS (SELECT DISTINCT d.document_id, d.a AS da, c.a AS ca FROM x d JOIN x c ON d.document_id = c.document_id AND d.de AND c.cr), r AS (SELECT da, ca FROM p GROUP BY 1, 2 HAVING count(*) <= 1)
        SELECT row_id, 'L4-04' AS rule_id, 1.0::DOUBLE AS score FROM general_ledger WHERE document_id IN (SELECT document_id FROM p SEMI JOIN r ON p.da = r.da AND p.ca = r.ca)""",
    "L4-05": f"""WITH x AS (SELECT *, {PLAIN('created_by')} AS u, {LATE} AS late FROM general_ledger WHERE {HUMAN}), u AS (SELECT u, avg(late::INTEGER) AS ratio FROM x GROUP BY 1 HAVING count(*) >= 10),
        o AS (SELECT count(*) AS n, avg(ratio) AS m, coalesce(stddev_samp(ratio), 0) AS s FROM u)
        SELECT row_id, 'L4-05' AS rule_id, 0.45::DOUBLE AS score FROM x WHERE late AND u IN (SELECT u FROM u, o WHERE o.n >= 3 AND ratio > m + 2.5 * s AND ratio >= 0.1)""",
    "L4-06": f"""WITH x AS (SELECT * FROM general_ledger WHERE coalesce({PLAIN('source')} IN ({_SOURCES(S.automated_sources)}), false) AND posting_date IS NOT NULL)
        SELECT row_id, 'L4-06' AS rule_id, 0.45::DOUBLE AS score FROM x WHERE posting_date IN (SELECT posting_date FROM x GROUP BY 1 HAVING count(DISTINCT document_id) >= 50)""",
    "EV01": f"""WITH dd AS (SELECT document_id, company_code, min(posting_date)::DATE AS day, max(trading_partner) AS pa, max({PLAIN('created_by')}) AS u, greatest(sum({D}), sum({C})) AS amt FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT * FROM dd WHERE amt > 0 AND NOT {BLANK('pa')} AND NOT {BLANK('u')} AND day IS NOT NULL), g AS (SELECT company_code, u, pa, day FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 AND max(amt) <= 30000 AND sum(amt) > 30000)
        SELECT row_id, 'EV01' AS rule_id, 0.8::DOUBLE AS score FROM general_ledger WHERE (document_id, company_code) IN (SELECT (document_id, company_code) FROM p SEMI JOIN g ON p.company_code = g.company_code AND p.u = g.u AND p.pa = g.pa AND p.day = g.day)""",
}


def _rule_query(rule: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return R.all_flags(gl_of(spark, d), read(spark, d, "employees"), only={rule}).filter(F.col("rule_id") == rule)

    return run


for _r in R.RULES:
    _name = "rule_" + _r.replace("-", "_")
    _Q[_name] = _rule_query(_r)
    _SQL[_name] = SQL_FLAGS[_r]


@query("""
    WITH d AS (SELECT DISTINCT company_code, fiscal_year, document_type, document_id, try_cast(regexp_extract(document_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM general_ledger WHERE document_id IS NOT NULL),
    g AS (SELECT *, n - lag(n) OVER (PARTITION BY company_code, fiscal_year, document_type ORDER BY n) AS gap FROM d WHERE n IS NOT NULL)
    SELECT company_code, fiscal_year, document_type, document_id, gap, least(gap / 10, 1.0) AS score FROM g WHERE gap > 1""")
def number_gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.number_gaps(gl_of(spark, d))


_PROFILE = lambda keys, name: f"""{name} AS (SELECT {keys}, median(gap) AS median, min(r0) <> max(r1) AS varied FROM (SELECT {keys}, r AS r0, r AS r1, CASE WHEN g BETWEEN 21 AND 100 THEN g END AS gap
        FROM (SELECT {keys}, coalesce(ref, '') AS r, floor(date_diff('second', lag(ts) OVER (PARTITION BY {keys} ORDER BY ts), ts) / 86400.0) AS g FROM p)) GROUP BY {keys} HAVING count(*) >= 3 AND count(gap) >= 1 AND stddev_pop(gap) / median(gap) <= 0.2)"""  # noqa: E731


@query(f"""
    WITH dd AS (SELECT document_id AS id, company_code AS co, min(posting_date) AS ts, max(document_type) AS ty, max(business_process) AS pr, max(trading_partner) AS pa, nullif(regexp_replace(upper(max(reference)), '[^0-9A-Z가-힣]', '', 'g'), '') AS ref,
        greatest(sum({D}), sum({C})) AS am, bool_or(coalesce({PLAIN("source")} IN ('manual', 'adjustment'), false)) AS manual FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT * FROM dd WHERE pr = 'P2P' AND ty IN ('KZ', 'KR') AND NOT {BLANK("pa")} AND am > 0 AND ts IS NOT NULL), {_PROFILE("co, pa, am", "series")}, {_PROFILE("co, pa", "usual")},
    q AS (SELECT p.*, series.median IS NOT NULL AS series, greatest(1, usual.median * 0.5) AS near, usual.median IS NOT NULL AS has FROM p LEFT JOIN series USING (co, pa, am) LEFT JOIN usual ON usual.co = p.co AND usual.pa = p.pa AND usual.varied),
    m AS (SELECT a.id, b.id AS earlier, b.ts AS bat, a.series, a.manual AND a.has AND a.ts::DATE - b.ts::DATE <= 90 AND floor(date_diff('second', b.ts, a.ts) / 86400.0) <= a.near AS close,
        CASE WHEN a.ref = b.ref THEN 0 WHEN a.ref IS NULL AND b.ref IS NOT NULL THEN 1 WHEN a.ts::DATE - b.ts::DATE <= 90 THEN CASE WHEN a.ref IS NULL THEN 3 ELSE 2 END END AS r
        FROM q a JOIN q b ON a.co = b.co AND a.pa = b.pa AND (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)) AND abs(a.am - b.am) <= greatest(least(a.am * 0.02, 100000), 1)),
    k AS (SELECT id, earlier, bat, CASE WHEN r = 0 OR NOT series THEN r WHEN close THEN 4 END AS r FROM m WHERE r IS NOT NULL),
    z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, bat DESC, earlier DESC) AS nr FROM k WHERE r IS NOT NULL)
    SELECT id AS document_id, earlier, ['reference', 'mixed', 'amount', 'blank', 'near_extra'][r + 1] AS kind FROM z WHERE nr = 1""")
def duplicate_payment_kinds(spark: SparkSession, d: str) -> DataFrame:
    docs = R.documents(gl_of(spark, d)).filter((F.col("process") == "P2P") & F.col("document_type").isin("KZ", "KR"))
    return R.duplicate_payment_matches(docs)


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
