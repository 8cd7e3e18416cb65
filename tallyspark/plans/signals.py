"""Queries of signals over time, of model preparation, of whole-ledger validation and of prior periods, with their SQL equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as S
from ..functions import base_amount, blank, ecdf
from ..operators import cases as CS
from ..operators import features as X
from ..operators import learn as L
from ..operators import population as P
from ..operators import profile as PR
from ..operators import scoring as K
from ..operators import timeseries as T
from ..operators import validate as V
from ..session import read, written
from . import analytics as A
from . import ledger as G
from .analytics import _RZ, _daily, _flags, dated, rounded
from .ledger import _APPROVAL, _ROUND, BASE, BLANK, LATE, PLAIN, WEEKEND, Query, gl_of
from .ledger import C as CR
from .ledger import D as DB
from .ledger import _SOURCES
from .problems import PROFILED, _counts_sql, _ledger_counts
from .review import _FOLDS, _recall

_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- over time
_END_RAW = """dy AS (SELECT posting_date::DATE AS day, count(*) AS n FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY 1), pc AS (SELECT day, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER () AS p FROM dy),
    er AS (SELECT day, (1 - least(date_diff('day', day, last_day(day)), 4) / 4.0) * greatest(0, p - 0.5) * 2 AS raw FROM pc)"""


@query(f"WITH {_END_RAW} SELECT row_id, round(coalesce(raw, 0), 9) AS raw FROM general_ledger LEFT JOIN er ON day = posting_date::DATE")
def period_end_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.period_end_scores(gl_of(spark, d)), 9, "raw")


def _spikes_sql(k: str) -> str:
    return f"""
    SELECT '{k}' AS variant, k AS subject, strftime(day, '%Y-%m-%d') AS day, round(score, 9) AS score, cold FROM (
    WITH c AS (SELECT {k} AS k, posting_date::DATE AS day, count(*) AS n FROM general_ledger WHERE posting_date IS NOT NULL AND NOT {BLANK(k)} GROUP BY 1, 2), b AS (SELECT k, min(day) AS lo, max(day) AS hi FROM c GROUP BY 1 HAVING sum(n) >= 10 AND count(*) >= 3),
    sp AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b), x AS (SELECT k, day, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (k, day)),
    y AS (SELECT k, day, CASE WHEN count(*) OVER a >= 3 THEN sum(n) OVER a END::DOUBLE AS v, CASE WHEN count(*) OVER p >= 3 THEN sum(n) OVER p END::DOUBLE AS b FROM x WINDOW a AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), p AS (PARTITION BY k ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT k, quantile_cont(b, 0.25) AS q1, quantile_cont(b, 0.5) AS q2, quantile_cont(b, 0.75) AS q3 FROM y GROUP BY 1 HAVING count(b) >= 2), m AS (SELECT k, quantile_cont(abs(b - q2), 0.5) AS mad FROM y JOIN g USING (k) GROUP BY 1),
    z AS (SELECT k, day, q2 = 0 AS cold, CASE WHEN q2 = 0 THEN 0.3 * (1 - exp(-v / 3)) WHEN v - q2 >= 3 AND v / greatest(q2, 1) >= 2 THEN greatest(0.0, least(30.0, ({_RZ("v", "q2", "mad", "(q3 - q1)")}) - 1.5)) ELSE 0 END AS score FROM y JOIN g USING (k) JOIN m USING (k) WHERE v > 0)
    SELECT * FROM z WHERE score > 0)"""


@query(" UNION ALL ".join(_spikes_sql(k) for k in ("created_by", "trading_partner")))
def group_spikes(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    parts = [T.group_spikes(gl, k).select(F.lit(k).alias("variant"), F.col(k).alias("subject"), "day", "score", "cold") for k in ("created_by", "trading_partner")]
    return dated(rounded(parts[0].unionByName(parts[1]), 9, "score"))


_PAIRS = (("gl_account", "business_process"), ("created_by", "gl_account"), ("trading_partner", "gl_account"))


@query(" UNION ALL ".join(f"""SELECT '{a}-{b}' AS variant, x AS first_value, y AS second_value, freq, rarity FROM (WITH p AS (SELECT {a} AS x, {b} AS y, count(*) AS freq FROM general_ledger WHERE NOT {BLANK(a)} AND NOT {BLANK(b)} GROUP BY 1, 2), f AS (SELECT freq, sum(freq) AS lines FROM p GROUP BY 1)
    SELECT x, y, p.freq, round((SELECT sum(lines) FROM f WHERE f.freq >= p.freq) / (SELECT sum(lines) FROM f), 6) AS rarity FROM p WHERE (SELECT count(*) FROM p) >= 50)""" for a, b in _PAIRS))
def pair_rarities(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    parts = [rounded(T.pair_rarity(gl, a, b), 6, "rarity").select(F.lit(f"{a}-{b}").alias("variant"), F.col(a).alias("first_value"), F.col(b).alias("second_value"), "freq", "rarity") for a, b in _PAIRS]
    return reduce(DataFrame.unionByName, parts)


_CONTEXT = f"cx AS (SELECT row_id, CASE WHEN {WEEKEND} OR {LATE} THEN 0.5 ELSE 0.0 END AS late, CASE WHEN coalesce({PLAIN('source')} IN ({_SOURCES(S.manual_sources)}), false) THEN 0.5 ELSE 0.0 END AS manual, CASE WHEN {_ROUND} THEN 0.5 ELSE 0.0 END AS round FROM (SELECT *, {BASE} AS b FROM general_ledger))"


@query(f"WITH {_CONTEXT} SELECT * FROM cx")
def context_flags(spark: SparkSession, d: str) -> DataFrame:
    return T.context_flags(gl_of(spark, d))


def _rar_sql(n: int, a: str, b: str) -> str:
    return f"""p{n} AS (SELECT {a} AS x, {b} AS y, count(*) AS freq FROM general_ledger WHERE NOT {BLANK(a)} AND NOT {BLANK(b)} GROUP BY 1, 2), f{n} AS (SELECT freq, sum(sum(freq)) OVER (ORDER BY freq DESC) / sum(sum(freq)) OVER () AS r FROM p{n} GROUP BY 1),
    q{n} AS (SELECT x, y, r FROM p{n} JOIN f{n} USING (freq) WHERE (SELECT count(*) FROM p{n}) >= 50)"""


_BURST = A._SQL["daily_burst"].split("SELECT company_code, strftime")[0].replace("WITH c AS", "c AS", 1)


@query(f"""
    WITH {_BURST}, bu AS (SELECT company_code, day, score FROM z WHERE score > 0), {_END_RAW}, {_CONTEXT}, {", ".join(_rar_sql(n, a, b) for n, (a, b) in enumerate(_PAIRS))},
    am AS (SELECT row_id, 2 * greatest(0, cume_dist() OVER (ORDER BY b) - 0.5) AS tail FROM (SELECT row_id, {BASE} AS b FROM general_ledger) WHERE b > 0),
    st AS (SELECT row_id, cume_dist() OVER (ORDER BY score) AS e FROM general_ledger g JOIN bu ON bu.company_code IS NOT DISTINCT FROM g.company_code AND bu.day = g.posting_date::DATE),
    j AS (SELECT g.row_id, coalesce(st.e, 0) AS strong, coalesce(er.raw, 0) AS pe, late, manual, cx.round AS rd, coalesce(am.tail, 0) AS a0, coalesce(q0.r, 0) AS a1, coalesce(q1.r, 0) AS a2, coalesce(q2.r, 0) AS a3 FROM general_ledger g LEFT JOIN st USING (row_id) LEFT JOIN er ON er.day = g.posting_date::DATE JOIN cx USING (row_id) LEFT JOIN am USING (row_id)
        LEFT JOIN q0 ON q0.x = g.gl_account AND q0.y = g.business_process LEFT JOIN q1 ON q1.x = g.created_by AND q1.y = g.gl_account LEFT JOIN q2 ON q2.x = g.trading_partner AND q2.y = g.gl_account),
    k AS (SELECT row_id, strong, (pe >= 0.05)::INTEGER + (late > 0)::INTEGER + (manual > 0)::INTEGER + (rd > 0)::INTEGER AS ctx, greatest(a0, a1, a2, a3) AS top, (a0 >= 0.95)::INTEGER + (a1 >= 0.95)::INTEGER + (a2 >= 0.95)::INTEGER + (a3 >= 0.95)::INTEGER AS h95, (a0 >= 0.9)::INTEGER + (a1 >= 0.9)::INTEGER + (a2 >= 0.9)::INTEGER + (a3 >= 0.9)::INTEGER AS h90 FROM j),
    o AS (SELECT row_id, CASE WHEN strong >= 0.3 THEN 0 WHEN ctx + h95 >= 3 AND ctx >= 1 AND top >= 0.95 THEN least(top, 0.8) WHEN ctx + h90 >= 3 AND ctx >= 1 AND top >= 0.9 THEN least(top * 0.7, 0.8) ELSE 0 END AS composite FROM k)
    SELECT row_id, round(composite, 6) AS composite FROM o WHERE composite > 0""")
def composite_signs(spark: SparkSession, d: str) -> DataFrame:
    """Lines for which several weak signs speak together."""
    from ..operators.skew import joined_by_key

    gl = gl_of(spark, d)
    b = T.burst(gl, ["company_code"]).select(F.coalesce("company_code", F.lit("")).alias("co"), "day", "score")
    x = joined_by_key(gl.select("row_id", F.coalesce("company_code", F.lit("")).alias("co"), F.col("posting_date").cast("date").alias("day")), b, ["co", "day"], "left")
    x = ecdf(x.select("row_id", "score"), "score", "strong").drop("score")
    parts = [T.period_end_scores(gl).withColumnRenamed("raw", "period_end"), T.context_flags(gl), T.amount_tail(gl), *(T.row_rarity(gl, a, b, f"r{k}") for k, (a, b) in enumerate(_PAIRS))]
    for p in parts:
        x = x.join(p, "row_id")
    return rounded(T.composite(x, ["tail", "r0", "r1", "r2"]).filter("composite > 0").select("row_id", "composite"), 6, "composite")


_UNITS = ("day", "week", "month")


@query(" UNION ALL ".join(f"""SELECT '{u}' AS unit, * FROM (WITH b AS (SELECT gl_account, year(posting_date)::INTEGER AS year, CASE WHEN {G.END} THEN 'period_end' ELSE 'regular' END AS lane, strftime(date_trunc('{u}', posting_date), '%Y-%m-%d') AS bucket, count(DISTINCT document_id) AS docs FROM general_ledger WHERE NOT {BLANK("gl_account")} AND posting_date IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL),
    g AS (SELECT gl_account, year, lane, count(*) AS nb, quantile_cont(docs, 0.25) AS q1, quantile_cont(docs, 0.5) AS q2, quantile_cont(docs, 0.75) AS q3 FROM b GROUP BY ALL), m AS (SELECT gl_account, year, lane, quantile_cont(abs(docs - q2), 0.5) AS mad FROM b JOIN g USING (gl_account, year, lane) GROUP BY ALL),
    z AS (SELECT gl_account, year, lane, bucket, docs, nb, {_RZ("docs::DOUBLE", "q2", "mad", "(q3 - q1)")} AS z FROM b JOIN g USING (gl_account, year, lane) JOIN m USING (gl_account, year, lane)) SELECT gl_account, year, lane, bucket, docs, round(z, 9) AS z FROM z WHERE z >= 3.5 AND docs >= 10 AND nb >= 3)""" for u in _UNITS))
def concentration_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Concentration by days, weeks and months, at period ends and otherwise apart."""
    gl = gl_of(spark, d)
    parts = [P.concentration(gl, u, lanes=True).select(F.lit(u).alias("unit"), "gl_account", "year", "lane", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "docs", F.round("z", 9).alias("z")) for u in _UNITS]
    return reduce(DataFrame.unionByName, parts)


# ---- model preparation
_N = ("debit_amount", "tax_amount")


@query(f"WITH m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _N)} FROM general_ledger) SELECT row_id, {', '.join(f'({c} IS NULL)::INTEGER AS {c}_was_null, coalesce({c}, m_{c}, 0.0) AS {c}' for c in _N)} FROM general_ledger, m")
def null_flags(spark: SparkSession, d: str) -> DataFrame:
    return L.null_flagged(gl_of(spark, d).select("row_id", *_N), list(_N))


def _yj(p: float) -> str:
    up = "ln(1 + v)" if p == 0 else f"(pow(v + 1, {p}) - 1) / {p}"
    down = "-ln(1 - v)" if p == 2 else f"-(pow(1 - v, {2 - p}) - 1) / {2 - p}"
    return f"CASE WHEN v >= 0 THEN {up} ELSE {down} END"


@query(f"""
    WITH x AS (SELECT row_id, local_amount / 1000 AS v FROM general_ledger WHERE local_amount IS NOT NULL), s AS (SELECT count(*) AS n, sum(sign(v) * ln(1 + abs(v))) AS s FROM x),
    l AS ({" UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, var_pop({_yj(p)}) AS vp FROM x" for p in L.LAMBDAS)}), b AS (SELECT p FROM l, s ORDER BY -n / 2.0 * ln(vp) + (p - 1) * s DESC LIMIT 1),
    t AS ({" UNION ALL ".join(f"SELECT row_id, {p}::DOUBLE AS p, {_yj(p)} AS v FROM x WHERE (SELECT p FROM b) = {p}" for p in L.LAMBDAS)}) SELECT row_id, round(v, 5) AS v FROM t""")
def yeo_johnson(spark: SparkSession, d: str) -> DataFrame:
    x = gl_of(spark, d).filter("local_amount is not null").select("row_id", (F.col("local_amount") / 1000).alias("v"))
    p = L.best_power(x, "v")
    return x.select("row_id", F.round(L.yeo_johnson(F.col("v"), 1.0 if p is None else p), 5).alias("v"))


_LEAST = {"cost_center": 0.30, "tax_code": 0.20, "tax_amount": 0.20, "trading_partner": 0.50}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(*) FILTER (WHERE NOT {BLANK(c)}) / count(*), 9) AS coverage, count(*) FILTER (WHERE NOT {BLANK(c)}) / count(*) >= {v} AS kept FROM general_ledger" for c, v in _LEAST.items()))
def sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.coverage(gl_of(spark, d), _LEAST), 9, "coverage")


@query(f"""
    WITH tr AS (SELECT {BASE} AS v FROM general_ledger WHERE upload_batch_id = (SELECT min(upload_batch_id) FROM general_ledger)), u AS (SELECT v, 1 AS w, NULL AS row_id FROM tr UNION ALL SELECT {BASE}, 0, row_id FROM general_ledger WHERE upload_batch_id > (SELECT min(upload_batch_id) FROM general_ledger)),
    c AS (SELECT row_id, sum(w) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (SELECT count(*) FROM tr) AS e FROM u) SELECT row_id, round(e, 9) AS place FROM c WHERE row_id IS NOT NULL""")
def stored_ecdf(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of later loads placed among those of the first."""
    gl = gl_of(spark, d).select("row_id", "upload_batch_id", base_amount().alias("v"))
    first = gl.agg(F.min("upload_batch_id")).first()[0]
    return rounded(L.stored_ecdf(gl.filter(F.col("upload_batch_id") == first), gl.filter(F.col("upload_batch_id") > first), "v", "place").select("row_id", "place"), 9, "place")


@query("""
    WITH tr AS (SELECT row_id, created_by FROM general_ledger WHERE fiscal_year = 2023), te AS (SELECT row_id, created_by FROM general_ledger WHERE fiscal_year = 2024)
    SELECT row_id, 'train' AS split FROM tr UNION ALL SELECT row_id, 'test' FROM te WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.created_by = te.created_by)""")
def user_holdout(spark: SparkSession, d: str) -> DataFrame:
    return L.user_holdout(gl_of(spark, d).select("row_id", "created_by", "fiscal_year"), "created_by", "fiscal_year", [2023], [2024]).select("row_id", "split")


@query("SELECT row_id, (('0x' || substring(md5(coalesce(document_id, '') || ':42'), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM general_ledger")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return gl_of(spark, d).select("row_id", L.bucket(F.col("document_id"), 5).cast("int").alias("fold"))


@query(f"WITH s AS ({A._SQL['row_scores']}) SELECT row_id, (coalesce(anomaly_score, 0) >= 0.25)::INTEGER AS label FROM general_ledger LEFT JOIN s USING (row_id)")
def pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    s = K.row_scores(_flags(spark, d)).select("row_id", "anomaly_score")
    return gl_of(spark, d).select("row_id").join(s, "row_id", "left").select("row_id", (F.coalesce("anomaly_score", F.lit(0.0)) >= 0.25).cast("int").alias("label"))


@query("""
    WITH m AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE debit_amount < 0 OR approved_by IS NULL) AS positives FROM general_ledger), h AS (SELECT md5(string_agg(column_name, ',' ORDER BY column_name)) AS schema_hash, count(*) AS n_columns FROM (DESCRIBE general_ledger))
    SELECT n_rows, positives, round((n_rows - positives) / positives, 6) AS imbalance, n_columns, schema_hash FROM m, h""")
def training_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size, balance and columns of a training table, by a label of its own."""
    import hashlib

    gl = gl_of(spark, d)
    cols = sorted(gl.columns)
    m = gl.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("debit_amount") < 0) | F.col("approved_by").isNull()).alias("positives"))
    return m.select("n_rows", "positives", F.round(F.try_divide(F.col("n_rows") - F.col("positives"), F.col("positives")), 6).alias("imbalance"), F.lit(len(cols)).cast("bigint").alias("n_columns"), F.lit(hashlib.md5(",".join(cols).encode()).hexdigest()).alias("schema_hash"))


@query(f"""
    WITH c AS ({_counts_sql()}), m AS (SELECT column_name, any_value(real) AS real, sum(CASE WHEN s IS NULL THEN n ELSE 0 END) / sum(n) AS nr, count(DISTINCT s) AS dist FROM c GROUP BY 1)
    SELECT column_name, CASE WHEN column_name IN ('document_id', 'reference') OR real LIKE 'datetime%' OR nr >= 0.95 THEN 'excluded' WHEN real IN ('int64', 'float64') THEN 'numeric' WHEN dist <= 50 THEN 'categorical_low' ELSE 'categorical_high' END AS feature_group FROM m""")
def column_groups(spark: SparkSession, d: str) -> DataFrame:
    """Columns by what a model can make of them, from the maintained value counts."""
    gl, counts = _ledger_counts(spark, d)
    whole = counts.withColumn("load_id", F.lit("all")).groupBy(*PR.KEYS).agg(F.sum("n").alias("n"))
    m = PR.metrics(whole).select("column_name", "null_rate", "distinct_count")
    return L.column_groups(m, {c: PR.dtype_name(gl.schema[c].dataType) for c in PROFILED}, ("document_id", "reference"))


@query(f"""
    WITH {_FOLDS}, s AS (SELECT scenario, sum(n_hit) / sum(n_truth) AS r FROM rk GROUP BY 1), o AS (SELECT sum(n_hit) / sum(n_truth) AS r FROM rk)
    SELECT scenario, round(s.r / o.r, 6) AS observed, 4.0 AS threshold, CASE WHEN s.r / o.r <= 4.0 THEN 'PASS' ELSE 'BLOCK' END AS status FROM s, o""")
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a scenario's recall is suspiciously better than the whole."""
    r = written(_recall(spark, d), "recall")
    o = r.agg(F.try_divide(F.sum("n_hit"), F.sum("n_truth"))).first()[0] or 1.0
    g = r.groupBy("scenario").agg((F.sum("n_hit") / F.sum("n_truth") / F.lit(float(o))).alias("x"))
    return g.select("scenario", F.round("x", 6).alias("observed"), F.lit(4.0).alias("threshold"), F.when(F.col("x") <= 4.0, "PASS").otherwise("BLOCK").alias("status"))


# ---- validation of the whole
@query(" UNION ALL ".join(f"SELECT '{a}' AS axis, {c}::INTEGER AS key, count(*) AS lines, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY 2" for a, c in (("weekday", "isodow(posting_date) - 1"), ("hour", "hour(posting_date)"), ("day", "day(posting_date)"), ("month", "month(posting_date)"))))
def temporal_patterns(spark: SparkSession, d: str) -> DataFrame:
    return V.temporal_patterns(gl_of(spark, d))


_MISSING = " OR ".join(BLANK(c) for c in ("document_id", "company_code", "fiscal_year", "fiscal_period", "posting_date", "document_date", "document_type", "gl_account"))


@query(f"""
    WITH r AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT ({_MISSING} OR NOT coalesce(fiscal_period BETWEEN 1 AND 16, false))) AS valid_rows, strftime(min(posting_date), '%Y-%m-%d') AS first, strftime(max(posting_date), '%Y-%m-%d') AS last FROM general_ledger),
    g AS (SELECT count(*) AS total_documents, count(*) FILTER (WHERE abs(x) < 0.01) AS valid_documents FROM (SELECT sum({DB}) - sum({CR}) AS x FROM general_ledger WHERE document_id IS NOT NULL GROUP BY document_id))
    SELECT *, round(50 * valid_rows / total_rows + 50 * valid_documents / total_documents, 4) AS score FROM r, g""")
def validation_score(spark: SparkSession, d: str) -> DataFrame:
    return V.validation_score(gl_of(spark, d))


@query(f"""
    WITH d AS ({G._SQL["validate_dispersion"]}), v AS ({G._SQL["validate_volatility"]}), m AS ({G._SQL["validate_business_days"]})
    SELECT * FROM (SELECT 'cv' AS measure, company_code AS subject, round(cv, 2) AS value FROM d UNION ALL SELECT 'skew', company_code, round(skew, 2) FROM d UNION ALL SELECT 'kurt', company_code, round(kurt, 2) FROM d UNION ALL SELECT 'hhi', company_code, round(hhi, 2) FROM d
    UNION ALL SELECT 'change', month, round(change, 2) FROM v UNION ALL SELECT 'seasonality', month, round(seasonality, 2) FROM v UNION ALL SELECT 'missing_business_days', 'all', count(*) FROM m) WHERE value IS NOT NULL""")
def statistical_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.statistical_summary(gl_of(spark, d)).withColumn("value", F.round("value", 2))


@query(_APPROVAL + f""" SELECT row_id, round(try_cast(amt / nullif(lim, 0) AS DOUBLE), 6) AS threshold_ratio, round(lim - amt, 2) AS threshold_gap, ({" + ".join(f"(amt >= {x})::INTEGER" for x in S.approval_ladder)})::DOUBLE AS approval_level, amt IS NOT NULL AND lim IS NOT NULL AS amount_resolved,
    CASE WHEN amt > lim AND lim = 0 THEN 'no_authority' WHEN amt > lim THEN 'over_limit' WHEN amt >= lim * 0.9 AND amt < lim THEN 'near_limit' END AS over_reason FROM a""")
def approval_details(spark: SparkSession, d: str) -> DataFrame:
    x = X.approval_details(gl_of(spark, d), read(spark, d, "employees"))
    return x.select("row_id", F.round("threshold_ratio", 6).alias("threshold_ratio"), F.round("threshold_gap", 2).alias("threshold_gap"), F.col("approval_level").cast("double").alias("approval_level"), "amount_resolved", "over_reason")


@query(f"""
    WITH t AS ({G._SQL["feature_text"]}) SELECT coalesce(business_process, '-') AS process, count(*) AS lines, count(*) FILTER (WHERE description_quality = 'missing') AS missing, count(*) FILTER (WHERE description_quality = 'corrupted') AS corrupted, count(risk_keyword) AS risk_words, round(avg(token_count), 6) AS mean_tokens FROM t JOIN general_ledger USING (row_id) GROUP BY 1""")
def description_profile(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d).select(F.coalesce("business_process", F.lit("-")).alias("process"), "line_text")
    return rounded(X.description_profile(gl, ["process"]), 6, "mean_tokens")


# ---- prior periods
@query(f"""
    WITH m AS (SELECT fiscal_year, company_code, gl_account, fiscal_period, sum({DB} + {CR}) AS a FROM general_ledger WHERE NOT {BLANK("gl_account")} GROUP BY ALL)
    SELECT fiscal_year, company_code, gl_account, fiscal_period, round(a / nullif(sum(a) OVER (PARTITION BY fiscal_year, company_code, gl_account), 0), 6) AS ratio FROM m""")
def prior_monthly_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each year's accounts, how their amounts spread over the months."""
    return rounded(P.monthly_shares(gl_of(spark, d)), 6, "ratio")


@query(f"SELECT fiscal_year, company_code, gl_account, round(sum({DB} + {CR}), 2) AS total, count(*) AS line_count, round(avg({DB} + {CR}), 2) AS mean FROM general_ledger WHERE NOT {BLANK('gl_account')} GROUP BY 1, 2, 3")
def prior_account_totals(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("debit_amount", F.lit(0.0)) + F.coalesce("credit_amount", F.lit(0.0))
    return gl_of(spark, d).filter(~blank("gl_account")).groupBy("fiscal_year", "company_code", "gl_account").agg(F.round(F.sum(v), 2).alias("total"), F.count(F.lit(1)).alias("line_count"), F.round(F.avg(v), 2).alias("mean"))


@query(f"SELECT trim(trading_partner, ' ') AS partner, gl_account, count(*) AS line_count, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE NOT {BLANK('trading_partner')} AND NOT {BLANK('gl_account')} GROUP BY 1, 2")
def partner_contents(spark: SparkSession, d: str) -> DataFrame:
    """What partners are posted to."""
    x = gl_of(spark, d).filter(~blank("trading_partner") & ~blank("gl_account"))
    return x.groupBy(F.trim("trading_partner").alias("partner"), "gl_account").agg(F.count(F.lit(1)).alias("line_count"), F.round(F.sum(base_amount()), 2).alias("amount"))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
