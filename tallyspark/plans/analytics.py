"""Population, time-series, scoring and learning queries over the ledger and the evaluated cases, with their SQL equivalents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as S
from ..functions import base_amount, blank, ecdf
from ..operators import features as X
from ..operators import learn as L
from ..operators import population as P
from ..operators import rules as R
from ..operators import scoring as K
from ..operators import timeseries as T
from ..operators.similarity import far_from_centre
from ..session import cached, read
from .ledger import _DIGIT, _ROUND, BASE, BLANK, SQL_FLAGS, C, D, Query, gl_of

_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_B = ", ".join(f"({k}, log10(1 + 1.0 / {k}))" for k in range(1, 10))


@query(f"""
    WITH t AS (SELECT company_code, greatest(abs({D}), abs({C})) AS m FROM general_ledger), x AS (SELECT company_code, {_DIGIT} AS k FROM t),
    n AS (SELECT company_code, count(*) AS n FROM x WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) >= 500), e(k, p) AS (VALUES {_B}),
    j AS (SELECT n.company_code, n.n, e.k, e.p, (SELECT count(*) FROM x WHERE x.company_code = n.company_code AND x.k = e.k) AS c FROM n, e),
    s AS (SELECT *, abs(sum(c / n - p) OVER (PARTITION BY company_code ORDER BY k)) AS dist FROM j)
    SELECT company_code, any_value(n) AS n, round(avg(abs(c / n - p)), 6) AS mad, round(sum(pow(c - n * p, 2) / (n * p)), 4) AS chi_square, round(max(dist), 6) AS ks, avg(abs(c / n - p)) > 0.012 AS deviates FROM s GROUP BY 1""")
def benford(spark: SparkSession, d: str) -> DataFrame:
    b = P.benford(gl_of(spark, d), ["company_code"])
    return b.select("company_code", "n", F.round("mad", 6).alias("mad"), F.round("chi_square", 4).alias("chi_square"), F.round("ks", 6).alias("ks"), "deviates")


@query(f"""
    WITH t AS (SELECT company_code, gl_account, greatest(abs({D}), abs({C})) AS m FROM general_ledger), x AS (SELECT company_code, gl_account, {_DIGIT} AS k FROM t),
    n AS (SELECT company_code, gl_account, count(*) AS n FROM x WHERE k IS NOT NULL AND NOT {BLANK("gl_account")} GROUP BY 1, 2 HAVING count(*) >= 500), e(k, p) AS (VALUES {_B}), c AS (SELECT company_code, gl_account, k, count(*) AS c FROM x GROUP BY 1, 2, 3),
    j AS (SELECT n.*, e.k, e.p, coalesce(c.c, 0) AS c FROM n CROSS JOIN e LEFT JOIN c ON c.company_code IS NOT DISTINCT FROM n.company_code AND c.gl_account = n.gl_account AND c.k = e.k),
    s AS (SELECT *, abs(sum(c / n - p) OVER (PARTITION BY company_code, gl_account ORDER BY k)) AS dist FROM j)
    SELECT company_code, gl_account, any_value(n) AS n, round(avg(abs(c / n - p)), 6) AS mad, round(sum(pow(c - n * p, 2) / (n * p)), 4) AS chi_square, round(max(dist), 6) AS ks, avg(abs(c / n - p)) > 0.012 AS deviates,
        coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (WHERE abs(c / n - p) > 0.012), '') AS digits FROM s GROUP BY 1, 2""")
def benford_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Per company and account, with the digits that deviate."""
    b = P.benford(gl_of(spark, d).filter(~blank("gl_account")), ["company_code", "gl_account"])
    return rounded(rounded(b, 6, "mad", "ks"), 4, "chi_square").withColumn("digits", F.array_join(F.col("digits").cast("array<string>"), ","))


@query(f"""
    WITH t AS (SELECT {BASE} AS b, coalesce(gl_account, '') AS gl_account, coalesce(strftime(posting_date, '%Y-%m'), '') AS month, coalesce(lower(trim(created_by, ' ')), '') AS creator FROM general_ledger), x AS (SELECT *, {_ROUND}::INTEGER AS r FROM t WHERE b > 0), o AS (SELECT avg(r) AS p FROM x),
    g AS ({" UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS key, count(*) AS n, sum(r)::BIGINT AS rounds FROM x WHERE {a} <> '' GROUP BY 2" for a in ("gl_account", "month", "creator"))}),
    h AS (SELECT g.*, p, rounds / n AS share, rounds / n - p AS excess FROM g, o WHERE n >= 100 AND rounds / n - p >= 0.05),
    b AS (SELECT axis, key, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))) AS tail FROM (SELECT h.*, unnest(range(greatest(rounds, 1), n + 1)) AS j FROM h) GROUP BY 1, 2)
    SELECT axis, key, n, rounds, round(share, 6) AS share, round(excess, 6) AS excess, round(coalesce(tail, 0), 6) AS p_value FROM h LEFT JOIN b USING (axis, key) WHERE coalesce(tail, 0) <= 0.01""")
def round_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.round_density(gl_of(spark, d)), 6, "share", "excess", "p_value")


_RZ = lambda x, med, mad, iqr: f"CASE WHEN {mad} > 0 THEN 0.6745 * ({x} - {med}) / {mad} WHEN {iqr} > 0 THEN ({x} - {med}) / ({iqr} / 1.349) WHEN {med} > 0 THEN ({x} - {med}) / greatest(sqrt({med}), 1) ELSE greatest(0.0, least({x}, 10.0)) END"


@query(f"""
    WITH b AS (SELECT gl_account, year(posting_date)::INTEGER AS year, strftime(date_trunc('month', posting_date), '%Y-%m-%d') AS bucket, count(DISTINCT document_id) AS docs FROM general_ledger WHERE NOT {BLANK("gl_account")} AND posting_date IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2, 3),
    g AS (SELECT gl_account, year, count(*) AS nb, quantile_cont(docs, 0.25) AS q1, quantile_cont(docs, 0.5) AS q2, quantile_cont(docs, 0.75) AS q3 FROM b GROUP BY 1, 2),
    m AS (SELECT gl_account, year, quantile_cont(abs(docs - q2), 0.5) AS mad FROM b JOIN g USING (gl_account, year) GROUP BY 1, 2),
    z AS (SELECT gl_account, year, bucket, docs, nb, {_RZ("docs::DOUBLE", "q2", "mad", "(q3 - q1)")} AS z FROM b JOIN g USING (gl_account, year) JOIN m USING (gl_account, year))
    SELECT gl_account, year, bucket, docs, round(z, 9) AS z FROM z WHERE z >= 3.5 AND docs >= 10 AND nb >= 3""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.concentration(gl_of(spark, d)), 9, "z").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query(f"""
    WITH p AS (SELECT trim(trading_partner, ' ') AS partner, posting_date::DATE AS day FROM general_ledger WHERE NOT {BLANK("trading_partner")} AND posting_date IS NOT NULL),
    g AS (SELECT partner, count(*) FILTER (WHERE day >= DATE '2023-09-01') AS now, count(*) FILTER (WHERE day < DATE '2023-09-01') AS bef, count(*) FILTER (WHERE day < DATE '2023-09-01' AND day >= DATE '2023-06-01') AS ly,
        min(day) FILTER (WHERE day >= DATE '2023-09-01') AS f, max(day) FILTER (WHERE day < DATE '2023-09-01') AS l FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE day >= DATE '2023-09-01') > 0),
    q AS (SELECT count(*) AS n, quantile_cont(now, 0.1) AS q FROM g)
    SELECT partner, 'first_seen' AS signal, now AS lines FROM g WHERE bef = 0 UNION ALL SELECT partner, 'dormant', now FROM g WHERE bef > 0 AND ly = 0 AND f - l >= 180
    UNION ALL SELECT partner, 'rare', now FROM g, q WHERE q.n >= 50 AND now <= q.q""")
def partner_signals(spark: SparkSession, d: str) -> DataFrame:
    return P.partner_signals(gl_of(spark, d), datetime.date(2023, 9, 1), datetime.date(2023, 6, 1))


@query(f"""SELECT trim(trading_partner, ' ') AS partner, count(*) AS lines, count(DISTINCT document_id) AS docs, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE NOT {BLANK("trading_partner")} GROUP BY 1""")
def partner_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.partner_summary(gl_of(spark, d))


# ---- every year and half of the ledger against the one before it; the periods are those that occur
_SPANS = """u AS (SELECT *, 'year' AS unit, fiscal_year AS period, month(posting_date) AS m FROM general_ledger WHERE fiscal_year IS NOT NULL
        UNION ALL SELECT *, 'half', year(posting_date) * 10 + CASE WHEN month(posting_date) > 6 THEN 2 ELSE 1 END, (month(posting_date) - 1) % 6 FROM general_ledger WHERE posting_date IS NOT NULL),
    pr AS (SELECT * FROM (SELECT unit, period, lag(period) OVER (PARTITION BY unit ORDER BY period) AS prior FROM (SELECT DISTINCT unit, period FROM u)) WHERE prior IS NOT NULL)"""
_PSI = """round(sum((pb - pa) * ln(pb / pa)), 6) AS psi FROM (SELECT unit, period, greatest(a / sum(a) OVER w, 1e-4) AS pa, greatest(b / sum(b) OVER w, 1e-4) AS pb FROM g WINDOW w AS (PARTITION BY unit, period)) GROUP BY 1, 2"""


@query(f"""
    WITH {_SPANS}, s AS (SELECT unit, period, gl_account, sum({BASE}) AS t, count(*) AS n, avg({BASE}) AS a FROM u WHERE NOT {BLANK("gl_account")} GROUP BY 1, 2, 3),
    j AS (SELECT c.unit, c.period, c.gl_account, c.n, p.n IS NULL AS is_new, 0.5 * abs(c.t - p.t) / greatest(abs(p.t), 1) + 0.3 * abs(c.n - p.n) / greatest(p.n, 1) + 0.2 * abs(c.a - p.a) / greatest(abs(p.a), 1) AS score
        FROM s c JOIN pr USING (unit, period) LEFT JOIN s p ON p.unit = c.unit AND p.period = pr.prior AND p.gl_account = c.gl_account)
    SELECT unit, period, gl_account, n, round(score, 5) AS score, is_new FROM j WHERE is_new OR score > 0.5""")
def activity_shift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.activity_shifts(gl_of(spark, d)), 5, "score")


@query(f"""
    WITH {_SPANS}, g AS (SELECT unit, period, gl_account, m, count(DISTINCT document_id) AS c FROM u WHERE NOT {BLANK("gl_account")} AND posting_date IS NOT NULL GROUP BY 1, 2, 3, 4),
    h AS (SELECT unit, period, gl_account, m, sum(a) AS a, sum(b) AS b FROM (SELECT unit, period, gl_account, m, c AS a, 0 AS b FROM g JOIN pr USING (unit, period) UNION ALL SELECT g.unit, pr.period, gl_account, m, 0, c FROM g JOIN pr ON g.unit = pr.unit AND g.period = pr.prior) GROUP BY 1, 2, 3, 4),
    t AS (SELECT unit, period, gl_account, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb FROM h GROUP BY 1, 2, 3), k AS (SELECT unit, period, gl_account, na, nb, a / na AS a, b / nb AS b FROM h JOIN t USING (unit, period, gl_account) WHERE least(na, nb) >= CASE WHEN unit = 'year' THEN 20 ELSE 3 END),
    r AS (SELECT unit, period, gl_account, na, nb, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * ln(2 * a / (a + b)) ELSE 0 END) + (CASE WHEN b > 0 THEN b * ln(2 * b / (a + b)) ELSE 0 END)) / 2)) AS d, abs(max(a) - max(b)) AS ts FROM k GROUP BY ALL)
    SELECT unit, period, gl_account, na, nb, round(d, 5) AS distance, round(ts, 6) AS top_shift FROM r WHERE d > 0.3 AND ts >= 0.25""")
def shape_shift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(P.shape_shifts(gl_of(spark, d), {"year": 20, "half": 3}), 5, "distance"), 6, "top_shift")


@query(f"""
    WITH {_SPANS}, m AS (SELECT unit, period, avg(debit_amount) AS m, CASE WHEN stddev_samp(debit_amount) > 0 THEN stddev_samp(debit_amount) ELSE 1 END AS s FROM u WHERE debit_amount IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT u.unit, pr.period, u.period = pr.period AS now, greatest(0, least(9, floor((debit_amount - m.m) / m.s * 2 + 5))) AS bin FROM u JOIN pr ON u.unit = pr.unit AND u.period IN (pr.period, pr.prior) JOIN m ON m.unit = pr.unit AND m.period = pr.prior WHERE debit_amount IS NOT NULL),
    g AS (SELECT unit, period, bin, count(*) FILTER (WHERE NOT now) AS a, count(*) FILTER (WHERE now) AS b FROM x GROUP BY 1, 2, 3)
    SELECT unit, period, {_PSI}""")
def drift_numeric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.drifts_numeric(gl_of(spark, d), "debit_amount"), 6, "psi")


@query(f"""
    WITH {_SPANS}, c AS (SELECT unit, period, document_type AS v, row_number() OVER (PARTITION BY unit, period ORDER BY count(*) DESC, document_type) AS r FROM u WHERE document_type IS NOT NULL GROUP BY 1, 2, 3),
    x AS (SELECT u.unit, pr.period, u.period = pr.period AS now, coalesce(c.v, '_OTHER_') AS bin FROM u JOIN pr ON u.unit = pr.unit AND u.period IN (pr.period, pr.prior) LEFT JOIN c ON c.unit = pr.unit AND c.period = pr.prior AND c.r <= 10 AND c.v = u.document_type),
    g AS (SELECT unit, period, bin, count(*) FILTER (WHERE NOT now) AS a, count(*) FILTER (WHERE now) AS b FROM x GROUP BY 1, 2, 3)
    SELECT unit, period, {_PSI}""")
def drift_categorical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.drifts_categorical(gl_of(spark, d), "document_type"), 6, "psi")


@query(f"""
    WITH t AS (SELECT gl_account, date_trunc('quarter', posting_date) AS t, sum({BASE}) AS v FROM general_ledger WHERE NOT {BLANK("gl_account")} AND posting_date IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT gl_account, sign(round(v - lag(v) OVER (PARTITION BY gl_account ORDER BY t), 2)) AS s FROM t),
    g AS (SELECT gl_account, count(*) AS steps, count(*) FILTER (WHERE s > 0) AS up, count(*) FILTER (WHERE s < 0) AS down FROM d WHERE s IS NOT NULL GROUP BY 1)
    SELECT gl_account, steps, up, down, round(greatest(up, down) / steps, 6) AS dominant FROM g WHERE steps >= 3 AND greatest(up, down) / steps >= 0.7""")
def trend_break(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.trend(gl_of(spark, d)), 6, "dominant")


@query(f"""
    WITH m AS (SELECT gl_account, date_trunc('month', posting_date) AS t, round(sum({D} - {C}), 2) AS net FROM general_ledger WHERE NOT {BLANK("gl_account")} AND posting_date IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT gl_account, count(*) AS n, count(*) FILTER (WHERE net > 0) AS up FROM m WHERE net <> 0 GROUP BY 1)
    SELECT gl_account, n, up, round(greatest(up, n - up) / n, 6) AS same_sign FROM g WHERE n >= 2 AND greatest(up, n - up) / n >= 0.8""")
def sign_bias(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.sign_bias(gl_of(spark, d)), 6, "same_sign")


def _daily(keys: str) -> str:
    k, on = (f"{keys}, ", f"USING ({keys}, day)") if keys else ("", "USING (day)")
    g = f"GROUP BY {keys}" if keys else ""
    return f"""
    WITH c AS (SELECT {k}posting_date::DATE AS day, count(*) AS n FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY ALL),
    e AS (SELECT {k}min(day) AS lo, max(day) AS hi FROM c {g}), sp AS (SELECT {k}unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM e),
    x AS (SELECT {k}day, coalesce(n, 0)::DOUBLE AS n FROM sp LEFT JOIN c {on})"""


@query(_daily("company_code") + f""",
    y AS (SELECT *, count(n) OVER w AS seen, quantile_cont(n, 0.25) OVER w AS q1, quantile_cont(n, 0.5) OVER w AS q2, quantile_cont(n, 0.75) OVER w AS q3, lag(n) OVER (PARTITION BY company_code ORDER BY day) AS prev FROM x WINDOW w AS (PARTITION BY company_code ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT *, CASE WHEN seen >= 7 THEN q2 END AS med, abs(prev - CASE WHEN seen >= 7 THEN q2 END) AS dev FROM y),
    r AS (SELECT *, CASE WHEN count(dev) OVER v >= 7 THEN quantile_cont(dev, 0.5) OVER v ELSE 0.0 END AS mad FROM m WINDOW v AS (PARTITION BY company_code ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
    z AS (SELECT company_code, day, n, greatest(0.0, least(30.0, ({_RZ("n", "med", "mad", "(q3 - q1)")}) - 1.5)) AS score FROM r WHERE med IS NOT NULL)
    SELECT company_code, strftime(day, '%Y-%m-%d') AS day, n, round(score, 9) AS score FROM z WHERE score > 0""")
def daily_burst(spark: SparkSession, d: str) -> DataFrame:
    return dated(rounded(T.burst(gl_of(spark, d), ["company_code"]), 9, "score"))


@query(_daily("company_code") + """,
    y AS (SELECT *, count(*) OVER w AS seen, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd FROM x WINDOW w AS (PARTITION BY company_code ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT company_code, strftime(day, '%Y-%m-%d') AS day, n::BIGINT AS n FROM y WHERE seen >= 7 AND n > m + 3 * sd""")
def rolling_outliers(spark: SparkSession, d: str) -> DataFrame:
    return dated(T.rolling_outliers(gl_of(spark, d), ["company_code"]))


@query("""
    WITH c AS (SELECT gl_account, posting_date::DATE AS day, count(*) AS n FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT gl_account, sum(n) OVER (PARTITION BY gl_account ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS r FROM c)
    SELECT gl_account, max(r)::BIGINT AS most FROM w GROUP BY 1 HAVING max(r) >= 5""")
def busy_ranges(spark: SparkSession, d: str) -> DataFrame:
    return T.busy_ranges(gl_of(spark, d), ["gl_account"])


@query(f"""
    WITH c AS (SELECT created_by, posting_date::DATE AS day, count(*) AS n FROM general_ledger WHERE posting_date IS NOT NULL AND NOT {BLANK("created_by")} GROUP BY 1, 2),
    b AS (SELECT created_by, min(day) AS lo, max(day) AS hi FROM c GROUP BY 1 HAVING sum(n) >= 10 AND count(*) >= 3), sp AS (SELECT created_by, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b),
    x AS (SELECT created_by, day, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (created_by, day)),
    y AS (SELECT created_by, day, sum(n) OVER (PARTITION BY created_by ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS r FROM x),
    z AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY created_by ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM y)
    SELECT created_by, strftime(day, '%Y-%m-%d') AS day, r, med FROM z WHERE r - med >= 3 AND r >= 2 * med""")
def group_frequency(spark: SparkSession, d: str) -> DataFrame:
    return dated(T.group_frequency(gl_of(spark, d), "created_by"))


@query(f"""
    WITH x AS (SELECT row_id, {BASE} AS b FROM general_ledger), e AS (SELECT row_id, cume_dist() OVER (ORDER BY b) AS p FROM x WHERE b > 0)
    SELECT row_id, round(2 * greatest(0, coalesce(p, 0) - 0.5), 9) AS tail FROM x LEFT JOIN e USING (row_id)""")
def amount_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.amount_tail(gl_of(spark, d)), 9, "tail")


@query(f"""
    WITH p AS (SELECT gl_account, business_process, count(*) AS freq FROM general_ledger WHERE NOT {BLANK("gl_account")} AND NOT {BLANK("business_process")} GROUP BY 1, 2), f AS (SELECT freq, sum(freq) AS lines FROM p GROUP BY 1)
    SELECT gl_account, business_process, freq, round((SELECT sum(lines) FROM f WHERE f.freq >= p.freq) / (SELECT sum(lines) FROM f), 6) AS rarity FROM p""")
def pair_rarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.pair_rarity(gl_of(spark, d), "gl_account", "business_process"), 6, "rarity")


@query("""SELECT strftime(posting_date, '%Y-%m') AS month, count(*) AS lines, count(*) FILTER (WHERE last_day(posting_date::DATE) - posting_date::DATE < 3) AS at_end, round(count(*) FILTER (WHERE last_day(posting_date::DATE) - posting_date::DATE < 3) / count(*), 6) AS share FROM general_ledger WHERE posting_date IS NOT NULL GROUP BY 1""")
def period_end_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.period_end_share(gl_of(spark, d)), 6, "share")


# ---- scores over all flags
def _flags(spark: SparkSession, d: str) -> DataFrame:
    """The long table, made once as long as its input files stay as they are: it is read by many plans."""
    inputs = [f"{d}/general_ledger.parquet", f"{d}/employees.parquet"]
    return cached(spark, "flags", inputs, lambda: R.all_flags(gl_of(spark, d), read(spark, d, "employees")), version=repr(S))


_FLAGS = "flags AS (" + " UNION ALL ".join(f"SELECT row_id, rule_id, score FROM ({s})" for s in SQL_FLAGS.values()) + ")"
_REG = "reg(rule_id, level, severity, factor, role) AS (VALUES " + ", ".join(f"('{r.id}', '{r.level}', {r.severity}, {r.factor}, {r.role})" for r in R.RULES.values()) + ")"
_PLAIN = ", ".join(f"'{r}'" for r in K.PLAIN_SIGNAL)
_STRENGTH = f"greatest(0.0, least(1.0, CASE WHEN rule_id IN ({_PLAIN}) THEN least(score, 1.0) / (severity / 5) WHEN score > severity / 5 THEN least(score, 1.0) ELSE least(score / (severity / 5), 1.0) END * (severity / 5) * factor * role))"
_BEST = ", ".join(f"max(CASE WHEN level = '{k}' THEN strength ELSE 0 END) * {w}" for k, w in K.LEVEL_WEIGHTS.items()).replace(", max", " + max")


@query(f"""
    WITH {_FLAGS}, {_REG}, e AS (SELECT row_id, rule_id, level, {_STRENGTH} AS strength FROM flags JOIN reg USING (rule_id)),
    g AS (SELECT row_id, round({_BEST}, 6) AS s, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS flagged_rules, count(*) FILTER (WHERE rule_id IN ('L1-01', 'L1-02', 'L1-03')) AS i, count(*) AS n FROM e GROUP BY 1)
    SELECT row_id, s AS anomaly_score, CASE WHEN i >= 1 AND n - i >= 2 THEN 'High' WHEN s >= 0.5 THEN 'High' WHEN s >= 0.25 THEN 'Medium' WHEN s >= 0.1 THEN 'Low' ELSE 'Normal' END AS risk_level, flagged_rules FROM g""")
def row_scores(spark: SparkSession, d: str) -> DataFrame:
    return K.row_scores(_flags(spark, d))


@query(f"WITH {_FLAGS} SELECT rule_id, count(*) AS flagged, round(avg(score), 6) AS avg_score, max(score) AS max_score FROM flags GROUP BY 1")
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.rule_summary(_flags(spark, d))


_UNITS = f"""units AS (SELECT g.document_id, list_sort(list_distinct(flatten(list(f.fired)))) AS fired, count(*) AS lines, round(sum({BASE}), 2) AS amount
    FROM general_ledger g JOIN (SELECT row_id, list(DISTINCT rule_id) AS fired FROM flags GROUP BY 1) f USING (row_id) WHERE document_id IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_FLAGS}, {_UNITS} SELECT document_id, array_to_string(fired, ',') AS fired, lines, amount FROM units")
def document_units(spark: SparkSession, d: str) -> DataFrame:
    return K.document_units(_flags(spark, d), gl_of(spark, d)).withColumn("fired", F.array_join("fired", ","))


@query(f"WITH {_FLAGS}, {_UNITS} SELECT document_id, lines, amount FROM units WHERE list_has_any(fired, ['L3-04', 'L4-01', 'L4-03', 'L2-05']) AND list_has_any(fired, ['L3-02', 'L1-05', 'L1-07'])")
def combination_search(spark: SparkSession, d: str) -> DataFrame:
    u = K.document_units(_flags(spark, d), gl_of(spark, d))
    return K.combine(u, ["L3-04", "L4-01", "L4-03", "L2-05"], ["L3-02", "L1-05", "L1-07"]).select("document_id", "lines", "amount")


@query(f"WITH {_FLAGS}, {_UNITS} SELECT document_id, lines, amount FROM units WHERE list_has_all(fired, ['L3-04', 'L4-04']) AND list_has_all(fired, ['L3-05'])")
def combination_strict(spark: SparkSession, d: str) -> DataFrame:
    u = K.document_units(_flags(spark, d), gl_of(spark, d))
    return K.combine(u, ["L3-04", "L4-04"], ["L3-05"], strict=True).select("document_id", "lines", "amount")


_CASES = "c AS (SELECT row_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, doc_count::DOUBLE AS doc_count, row_count::DOUBLE AS row_count FROM contract_v2_group_top_case_eval)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contract_v2_group_top_case_eval").select("row_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), F.col("doc_count").cast("double").alias("doc_count"), F.col("row_count").cast("double").alias("row_count"))


@query(f"""
    WITH {_CASES}, a AS (SELECT row_id, rank() OVER (ORDER BY score DESC) AS r FROM c WHERE score IS NOT NULL), b AS (SELECT row_id, rank() OVER (ORDER BY doc_count DESC) AS r FROM c WHERE doc_count IS NOT NULL), e AS (SELECT row_id, rank() OVER (ORDER BY row_count DESC) AS r FROM c WHERE row_count IS NOT NULL)
    SELECT row_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) + coalesce(1.0 / (60 + e.r), 0), 9) AS rrf FROM c LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id) LEFT JOIN e USING (row_id)""")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.reciprocal_rank_fusion(_cases(spark, d), "row_id", ["score", "doc_count", "row_count"], S.rrf_k), 9, "rrf")


@query(f"""
    WITH {_CASES}, a AS (SELECT row_id, cume_dist() OVER (ORDER BY score) AS e FROM c WHERE score > 0), b AS (SELECT row_id, cume_dist() OVER (ORDER BY doc_count) AS e FROM c WHERE doc_count > 0)
    SELECT row_id, round(1 - (1 - coalesce(a.e, 0)) * (1 - coalesce(b.e, 0)), 9) AS noisy_or FROM c LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id)""")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.noisy_or(_cases(spark, d), "row_id", ["score", "doc_count"]), 9, "noisy_or")


@query("""
    WITH c AS (SELECT theme_id, row_id, score FROM contract_v2_group_top_case_eval WHERE theme_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)), r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, row_id) AS place FROM c)
    SELECT theme_id, row_id, place FROM r WHERE place <= 5""")
def theme_ranks(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contract_v2_group_top_case_eval").filter("score is not null and not isnan(score)")
    return K.theme_ranks(c, "theme_id", "score", "row_id", 5).select("theme_id", "row_id", "place")


@query("""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY evaluated_at DESC NULLS LAST, row_id DESC) AS k FROM contract_v2_group_top_case_eval WHERE case_id IS NOT NULL)
    SELECT case_id, row_id, band FROM c WHERE k = 1""")
def latest_evaluations(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contract_v2_group_top_case_eval").filter("case_id is not null").select("case_id", "row_id", "evaluated_at", "band")
    return K.latest_decisions(c, "case_id", "evaluated_at", "row_id").select("case_id", "row_id", "band")


@query("""
    WITH x AS (SELECT cume_dist() OVER (ORDER BY score) AS p, score FROM contract_v2_group_top_case_eval WHERE score > 0 AND NOT isnan(score))
    SELECT CASE WHEN p > 0.99 THEN 'immediate' WHEN p > 0.95 THEN 'review' WHEN p > 0.8 THEN 'candidate' ELSE 'none' END AS review_band, count(*) AS cases, min(score) AS least FROM x GROUP BY 1""")
def review_bands(spark: SparkSession, d: str) -> DataFrame:
    x = ecdf(_cases(spark, d).filter("score > 0"), "score", "p")
    band = F.when(F.col("p") > 0.99, "immediate").when(F.col("p") > 0.95, "review").when(F.col("p") > 0.8, "candidate").otherwise("none")
    return x.groupBy(band.alias("review_band")).agg(F.count(F.lit(1)).alias("cases"), F.min("score").alias("least"))


@query(f"""
    WITH {_FLAGS}, f AS (SELECT DISTINCT rule_id, document_id FROM flags JOIN general_ledger USING (row_id) WHERE document_id IS NOT NULL), b AS (SELECT document_id FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1 HAVING abs(sum({D} - {C})) > 0.01)
    SELECT rule_id, count(*) FILTER (WHERE document_id IN (SELECT document_id FROM b)) AS tp, count(*) FILTER (WHERE document_id NOT IN (SELECT document_id FROM b)) AS fp,
        (SELECT count(*) FROM b) - count(*) FILTER (WHERE document_id IN (SELECT document_id FROM b)) AS fn FROM f GROUP BY 1""")
def rule_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How each test's documents agree with a truth, here the unbalanced documents."""
    gl = gl_of(spark, d).filter("document_id is not null")
    f = _flags(spark, d).join(gl.select("row_id", "document_id"), "row_id").select("rule_id", "document_id")
    b = R.document_tests(gl, X.masters(read(spark, d, "employees"))).filter("rule_id = 'L1-01'").join(gl.select("row_id", "document_id"), "row_id").select("document_id").distinct()
    hits = f.distinct().join(b.withColumn("bad", F.lit(1)), "document_id", "left")
    n = b.count()
    return hits.groupBy("rule_id").agg(F.count("bad").alias("tp"), (F.count(F.lit(1)) - F.count("bad")).alias("fp"), (F.lit(n) - F.count("bad")).alias("fn"))


@query(f"""
    WITH {_CASES}, a AS (SELECT row_id, rank() OVER (ORDER BY score DESC) AS r FROM c WHERE score IS NOT NULL), b AS (SELECT row_id, rank() OVER (ORDER BY doc_count DESC) AS r FROM c WHERE doc_count IS NOT NULL),
    q AS (SELECT quantile_cont(row_count, 0.95) AS q FROM c WHERE row_count > 0), e AS (SELECT row_id, rank() OVER (ORDER BY row_count DESC) AS r FROM c, q WHERE row_count >= q.q)
    SELECT row_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) + coalesce(1.0 / (60 + e.r), 0), 9) AS rrf FROM c LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id) LEFT JOIN e USING (row_id)""")
def boosted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.boosted_fusion(_cases(spark, d), "row_id", ["score", "doc_count"], "row_count"), 9, "rrf")


@query(f"WITH {_CASES} " + " UNION ALL ".join(f"SELECT '{k}' AS score_name, count(*) AS n, round(count(*) FILTER (WHERE coalesce({k}, 0) <> 0) / count(*), 6) AS non_zero_rate, round(count(DISTINCT coalesce({k}, 0)) / count(*), 6) AS distinct_share, round(count(*) FILTER (WHERE coalesce({k}, 0) = (SELECT max(coalesce({k}, 0)) FROM c)) / count(*), 6) AS top_tie_share FROM c" for k in ("score", "doc_count", "row_count")))
def score_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.score_diagnostics(_cases(spark, d), ["score", "doc_count", "row_count"]), 6, "non_zero_rate", "distinct_share", "top_tie_share")


@query(f"""
    WITH {_FLAGS}, g AS (SELECT row_id, bool_or(rule_id = 'L3-02') AS m, bool_or(rule_id IN ('L3-04', 'L3-07'))::INTEGER + bool_or(rule_id IN ('L1-05', 'L1-07', 'L1-04'))::INTEGER + bool_or(rule_id IN ('L4-04', 'L2-03', 'L2-05'))::INTEGER + bool_or(rule_id IN ('L4-01', 'L4-03'))::INTEGER AS k FROM flags GROUP BY 1)
    SELECT row_id, k / 4 AS topside FROM g WHERE m""")
def topside_scores(spark: SparkSession, d: str) -> DataFrame:
    return K.topside(_flags(spark, d))


@query(f"WITH {_FLAGS}, {_UNITS} SELECT rule_id, count(*) AS units, count(*) FILTER (WHERE len(fired) = 1) AS alone FROM (SELECT unnest(fired) AS rule_id, fired FROM units) GROUP BY 1")
def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.coverage(K.document_units(_flags(spark, d), gl_of(spark, d)))


@query("""
    WITH u AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, i, avg(v::DOUBLE) AS m FROM u GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
    d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], c) AS distance FROM embeddings JOIN c USING (label)), q AS (SELECT label, quantile_cont(distance, 0.95) AS q FROM d GROUP BY 1)
    SELECT vec_id, label, round(distance, 6) AS distance FROM d JOIN q USING (label) WHERE distance > q""")
def far_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(far_from_centre(read(spark, d, "embeddings"), "vec_id", "embedding", "label"), 6, "distance")


# ---- learning
@query()
def reconstruction_errors(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import detect

    return detect.reconstruction_errors(detect.model_features(gl_of(spark, d)), detect.FEATURES)


@query("""
    WITH f AS (SELECT document_type, count(*) / (SELECT count(*) FROM general_ledger) AS f FROM general_ledger WHERE document_type IS NOT NULL GROUP BY 1)
    SELECT row_id, round(coalesce(f.f, 0), 9) AS type_frequency, round(sign(local_amount) * ln(1 + abs(local_amount)), 6) AS signed_log_amount FROM general_ledger LEFT JOIN f USING (document_type)""")
def encoded_features(spark: SparkSession, d: str) -> DataFrame:
    x = L.frequency_encoded(gl_of(spark, d), "document_type", "type_frequency")
    return x.select("row_id", F.round("type_frequency", 9).alias("type_frequency"), F.round(L.signed_log(F.col("local_amount")), 6).alias("signed_log_amount"))


@query("""
    WITH f AS (SELECT document_type AS v, count(*) / (SELECT count(*) FROM general_ledger) AS f FROM general_ledger WHERE document_type IS NOT NULL GROUP BY 1)
    SELECT row_id, CASE WHEN f >= 0.05 THEN document_type WHEN document_type IS NOT NULL THEN '_OTHER_' END AS document_type, coalesce((source = 'Manual')::INTEGER, 0) AS source_Manual FROM general_ledger LEFT JOIN f ON document_type = v""")
def rare_categories(spark: SparkSession, d: str) -> DataFrame:
    return L.one_hot(L.rare_grouped(gl_of(spark, d), "document_type", 0.05), "source", ["Manual"]).select("row_id", "document_type", "source_Manual")


_SCALED = ("debit_amount", "credit_amount", "local_amount", "line_number")


@query(" UNION ALL ".join(f"""(WITH v AS (SELECT {c}::DOUBLE AS v FROM general_ledger WHERE {c} IS NOT NULL), m AS (SELECT avg(v) AS m, stddev_samp(v) AS sd, stddev_pop(v) AS sp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v),
    k AS (SELECT avg(pow((v - m) / sp, 3)) AS sk FROM v, m) SELECT '{c}' AS column_name, CASE WHEN abs(sk) > 2 THEN 'robust' ELSE 'standard' END AS policy, round(CASE WHEN abs(sk) > 2 THEN q2 ELSE m END, 4) AS center, round(CASE WHEN abs(sk) > 2 THEN q3 - q1 ELSE sd END, 3) AS scale FROM m, k)""" for c in _SCALED))
def scaling_policy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(L.scaling_policy(gl_of(spark, d), list(_SCALED)), 4, "center"), 3, "scale")


@query(f"""
    WITH x AS (SELECT created_by, row_id, ln(1 + {BASE}) AS a, coalesce(fiscal_period, 0) AS p, row_number() OVER u AS pos, count(*) OVER (PARTITION BY created_by) AS n FROM general_ledger WHERE created_by IS NOT NULL
        WINDOW u AS (PARTITION BY created_by ORDER BY posting_date NULLS LAST, row_id)),
    w AS (SELECT created_by, row_id, pos, n, count(*) OVER v AS valid, sum(a) OVER v AS total, first_value(a) OVER v AS first_amount, sum(p) OVER v AS periods FROM x WINDOW v AS (PARTITION BY created_by ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
    SELECT created_by, row_id, pos AS "at", valid, round(total, 6) AS total, round(CASE WHEN valid < 16 THEN 0 ELSE first_amount END, 6) AS first_amount, periods::DOUBLE AS periods FROM w WHERE pos >= 16 OR (n < 16 AND pos = n)""")
def user_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each user's lines, told by what their steps add up to and the first step (0 where it is padding)."""
    y = sequences_of_users(spark, d)
    total = lambda k: F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[k])
    return y.select("created_by", "row_id", "at", F.col("valid").cast("bigint").alias("valid"), F.round(total(0), 6).alias("total"), F.round(F.col("steps")[0][0], 6).alias("first_amount"), total(1).alias("periods"))


def sequences_of_users(spark: SparkSession, d: str) -> DataFrame:
    x = gl_of(spark, d).withColumn("amount", F.log1p(base_amount()))
    undated = F.lit(10_000_000) + F.floor(F.col("row_id") / 100_000)  # after all days, as undated lines come last
    return L.sequences(x, "created_by", F.coalesce(F.unix_date(F.col("posting_date").cast("date")).cast("bigint"), undated), ["posting_date", "row_id"], ["amount", "fiscal_period"])


@query("""
    WITH tr AS (SELECT row_id, created_by FROM general_ledger WHERE posting_date < TIMESTAMP '2024-07-01'), te AS (SELECT row_id, created_by FROM general_ledger WHERE posting_date >= TIMESTAMP '2024-07-01')
    SELECT row_id, 'train' AS split FROM tr UNION ALL SELECT row_id, 'test' FROM te WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.created_by = te.created_by)""")
def temporal_holdout(spark: SparkSession, d: str) -> DataFrame:
    return L.temporal_holdout(gl_of(spark, d).select("row_id", "created_by", "posting_date"), "posting_date", "created_by", datetime.datetime(2024, 7, 1)).select("row_id", "split")


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
