"""Queries of cases, queues and evaluation, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blank
from ..operators import cases as C
from ..operators import features as X
from ..operators import population as P
from ..operators import rules as R
from ..operators import scoring as K
from ..session import at_once, read, written
from . import analytics as A
from .analytics import _BEST, _CASES, _FLAGS, _REG, _STRENGTH, _cases, _flags
from .ledger import BASE, BLANK, Query, gl_of
from .ledger import C as CR
from .ledger import D as DB
from .ledger import _SQL as LEDGER_SQL

_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_SCORES = A._SQL["row_scores"]
_TOPIC = "topics(rule_id, topic, prim) AS (VALUES " + ", ".join(f"('{r}', '{t}', {str(R.RULES[r].role == 1.0).lower()})" for r, t in K.TOPICS.items()) + ")"
_EV = f"ev AS (SELECT document_id, rule_id, max({_STRENGTH}) AS strength FROM flags JOIN reg USING (rule_id) JOIN general_ledger USING (row_id) WHERE document_id IS NOT NULL GROUP BY 1, 2)"


@query(f"""
    WITH s AS ({_SCORES}), p AS (SELECT *, cume_dist() OVER (ORDER BY anomaly_score) AS p FROM s)
    SELECT row_id, anomaly_score, CASE WHEN anomaly_score <= 0 THEN 'Normal' WHEN p > 0.9 THEN 'High' WHEN p > 0.75 THEN 'Medium' WHEN p > 0.5 THEN 'Low' ELSE 'Normal' END AS risk_level FROM p""")
def risk_by_quantile(spark: SparkSession, d: str) -> DataFrame:
    return K.quantile_levels(K.row_scores(_flags(spark, d)).select("row_id", "anomaly_score"))


@query(f"""
    WITH s AS ({_SCORES}), {_FLAGS}, f AS (SELECT row_id, string_agg(DISTINCT rule_id || ':immediate', ',' ORDER BY rule_id || ':immediate') AS reasons FROM flags WHERE rule_id = 'L1-04' AND score >= 0.8 GROUP BY 1)
    SELECT row_id, CASE WHEN reasons IS NULL THEN anomaly_score ELSE greatest(anomaly_score, 0.5) END AS anomaly_score, CASE WHEN reasons IS NULL THEN risk_level ELSE 'High' END AS risk_level, coalesce(reasons, '') AS reasons FROM s LEFT JOIN f USING (row_id)""")
def policy_floors(spark: SparkSession, d: str) -> DataFrame:
    f = _flags(spark, d)
    return K.policy_floors(K.row_scores(f), f).select("row_id", "anomaly_score", "risk_level", "reasons")


@query(f"WITH {_FLAGS}, {_REG}, {_TOPIC}, {_EV} SELECT document_id, topic, CASE WHEN bool_or(prim AND strength > 0) THEN 'LOW' ELSE 'CONTEXT' END AS tier FROM ev JOIN topics USING (rule_id) GROUP BY 1, 2")
def topic_tiers(spark: SparkSession, d: str) -> DataFrame:
    return C.topic_tiers(C.document_evidence(_flags(spark, d), gl_of(spark, d)))


_CASE = f"""{_FLAGS}, {_REG}, {_TOPIC}, {_EV}, am AS (SELECT document_id, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1),
    g AS (SELECT document_id, bool_or(prim AND strength > 0) AS low, count(*) FILTER (WHERE prim) AS primaries, count(*) AS rules, {" + ".join(f"max(CASE WHEN topic = '{t}' THEN strength ELSE 0 END) * {w}" for t, w in K.PRIORITY.items())} AS pr FROM ev JOIN topics USING (rule_id) GROUP BY 1),
    c AS (SELECT g.*, amount, greatest(0, amount / max(amount) OVER ()) AS ams FROM g JOIN am USING (document_id)),
    cs AS (SELECT document_id, CASE WHEN low THEN 'LOW' ELSE 'CONTEXT' END AS tier, primaries, rules, amount, (low::INTEGER * 1000000 + least(primaries, 99) * 10000 + least(rules, 99) * 100 + round_even(ams * 99, 0))::DOUBLE AS sort_score, round(pr + ams * 0.25, 6) AS priority FROM c)"""


def _case_table(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    x = C.cases(C.document_evidence(_flags(spark, d), gl), gl)
    return x.select("document_id", "tier", "primaries", "rules", "amount", "sort_score", F.round("priority", 6).alias("priority"))


@query(f"WITH {_CASE} SELECT * FROM cs")
def document_cases(spark: SparkSession, d: str) -> DataFrame:
    return _case_table(spark, d)


_CHAIN = f"""k AS ({LEDGER_SQL["duplicate_payment_kinds"]}), e AS (SELECT document_id, min(earlier) AS up FROM k GROUP BY 1),
    w(document_id, root) AS (SELECT document_id, up FROM e UNION ALL SELECT w.document_id, e.up FROM w JOIN e ON e.document_id = w.root),
    ch AS (SELECT document_id, root FROM w WHERE root NOT IN (SELECT document_id FROM e) UNION SELECT up, up FROM e WHERE up NOT IN (SELECT document_id FROM e))"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    docs = R.documents(gl_of(spark, d)).filter((F.col("process") == "P2P") & F.col("document_type").isin("KZ", "KR"))
    return C.chains(R.duplicate_payment_matches(docs).select("document_id", "earlier"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT document_id, root FROM ch")
def flow_units(spark: SparkSession, d: str) -> DataFrame:
    """Chains of payments that repeat one another, each named by its first document."""
    return _chains(spark, d)


@query(f"WITH RECURSIVE {_CHAIN}, {_CASE} SELECT document_id, rules FROM cs WHERE document_id NOT IN (SELECT document_id FROM ch)")
def units_outside_flows(spark: SparkSession, d: str) -> DataFrame:
    a, b = at_once(lambda: _case_table(spark, d), lambda: _chains(spark, d))
    return C.without(a, b).select("document_id", "rules")


@query(f"""
    WITH {_CASE}, q AS (SELECT 'audit_risk' AS queue, document_id AS unit_id, sort_score AS score FROM cs UNION ALL SELECT 'priority', document_id, priority FROM cs
        UNION ALL SELECT 'data_quality', document_id, count(*)::DOUBLE FROM flags JOIN general_ledger USING (row_id) WHERE rule_id IN ('L1-01', 'L1-02', 'L1-03') AND document_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'partner', trim(trading_partner, ' '), round(sum({BASE}), 2) FROM general_ledger WHERE NOT {BLANK("trading_partner")} GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY score DESC, unit_id) AS place FROM q WHERE score IS NOT NULL) SELECT queue, place::INTEGER AS place, unit_id, score FROM r WHERE place <= 50""")
def review_queues(spark: SparkSession, d: str) -> DataFrame:
    """The 50 first of each queue."""
    gl, cs = gl_of(spark, d), written(_case_table(spark, d), "cases")
    bad = _flags(spark, d).filter(F.col("rule_id").isin("L1-01", "L1-02", "L1-03")).join(gl.filter("document_id is not null").select("row_id", "document_id"), "row_id").groupBy(F.col("document_id").alias("unit_id")).agg(F.count(F.lit(1)).alias("score"))
    parts = {"audit_risk": cs.select(F.col("document_id").alias("unit_id"), F.col("sort_score").alias("score")), "priority": cs.select(F.col("document_id").alias("unit_id"), F.col("priority").alias("score")), "data_quality": bad, "partner": P.partner_summary(gl).select(F.col("partner").alias("unit_id"), F.col("amount").alias("score"))}
    return C.queues(parts, 50)


_BAND = lambda v: f"""SELECT row_id, CASE WHEN r IS NULL THEN 'none' WHEN r <= ceil(n * 0.0125) THEN 'immediate' WHEN r <= ceil(n * 0.05) THEN 'review' WHEN r <= ceil(n * 0.25) THEN 'candidate' ELSE 'none' END AS band
    FROM (SELECT row_id, CASE WHEN {v} > 0 THEN rank() OVER (ORDER BY CASE WHEN {v} > 0 THEN {v} END DESC NULLS LAST) END AS r, count(*) OVER () AS n FROM c)"""  # noqa: E731


@query(f"""
    WITH {_CASES}, a AS ({_BAND("score")}), b AS ({_BAND("doc_count")})
    SELECT row_id, a.band AS score_band, b.band AS size_band, CASE WHEN a.band = 'immediate' AND b.band = 'immediate' THEN 'immediate' WHEN 'immediate' IN (a.band, b.band) OR 'review' IN (a.band, b.band) THEN 'review' WHEN 'candidate' IN (a.band, b.band) THEN 'candidate' ELSE 'none' END AS joint_band FROM a JOIN b USING (row_id)""")
def joint_bands(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d)
    a, b = C.rank_bands(c, "row_id", "score").withColumnRenamed("band", "score_band"), C.rank_bands(c, "row_id", "doc_count").withColumnRenamed("band", "size_band")
    return a.join(b, "row_id").withColumn("joint_band", C.joint_band("score_band", "size_band"))


_TIERS = "CASE WHEN score > 0.9 THEN 'strong' WHEN score > 0.6 THEN 'moderate' WHEN score > 0.3 THEN 'ml_quantile' ELSE 'weak' END"


@query(f"""
    WITH {_CASES}, t AS (SELECT row_id, {_TIERS} AS tier, rule_count AS n, score AS e, row_id % 2 = 0 AS ml, score > 0 AS sig FROM c JOIN (SELECT row_id, rule_count FROM contract_v2_group_top_case_eval) USING (row_id))
    SELECT row_id, CASE WHEN tier = 'strong' AND coalesce(n, 0) >= 2 THEN 'immediate' WHEN tier = 'strong' OR (tier = 'moderate' AND coalesce(n, 0) >= 2) OR (tier = 'ml_quantile' AND coalesce(e, 0) >= 0.99 AND coalesce(n, 0) >= 2 AND ml) THEN 'review' WHEN sig THEN 'candidate' ELSE 'none' END AS band FROM t""")
def tier_bands(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contract_v2_group_top_case_eval").withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    t = c.select("row_id", F.when(F.col("score") > 0.9, "strong").when(F.col("score") > 0.6, "moderate").when(F.col("score") > 0.3, "ml_quantile").otherwise("weak").alias("tier"), F.col("rule_count").alias("n"), F.col("score").alias("e"), (F.col("row_id") % 2 == 0).alias("ml"), (F.col("score") > 0).alias("sig"))
    return t.select("row_id", C.tier_band("tier", "n", "e", "ml", "sig").alias("band"))


@query(f"WITH {_CASES} SELECT row_id, score, doc_count, row_count FROM c ORDER BY score DESC NULLS LAST, doc_count DESC NULLS LAST, row_count DESC NULLS LAST, row_id LIMIT 500")
def tie_break(spark: SparkSession, d: str) -> DataFrame:
    """The 500 first cases."""
    return C.ordered_by_ladder(_cases(spark, d), ["score", "doc_count", "row_count"], "row_id", 500)


_FINDINGS = {"benford_accounts": ("concat_ws('|', company_code, gl_account)", "mad", "WHERE deviates"), "activity_shift": ("concat_ws('|', unit, period, gl_account)", "score", "WHERE score IS NOT NULL"), "shape_shift": ("concat_ws('|', unit, period, gl_account)", "distance", ""), "round_density": ("concat_ws('|', axis, key)", "excess", ""), "trend_break": ("gl_account", "dominant", ""), "sign_bias": ("gl_account", "same_sign", "")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS finding, {key} AS subject, {v}::DOUBLE AS measure FROM ({A._SQL[k]}) {cond}" for k, (key, v, cond) in _FINDINGS.items()))
def macro_findings(spark: SparkSession, d: str) -> DataFrame:
    """What holds of populations rather than of lines, as one table."""
    q = A.queries()
    parts = at_once(*((lambda k=k: q[k](spark, d)) for k in _FINDINGS))
    out = None
    for (k, (key, v, cond)), p in zip(_FINDINGS.items(), parts, strict=True):
        x = (p.filter(cond.removeprefix("WHERE ")) if cond else p).select(F.lit(k).alias("finding"), F.expr(key).alias("subject"), F.col(v).cast("double").alias("measure"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""
    WITH {_CASE}, z AS ({LEDGER_SQL["feature_zscore"]}), a AS (SELECT DISTINCT lower(trim(document_id)) AS k, document_id AS u FROM cs), b AS (SELECT DISTINCT lower(trim(document_id)) AS k, row_id AS u FROM z JOIN general_ledger USING (row_id) WHERE amount_zscore > 3 AND document_id IS NOT NULL)
    SELECT substring(sha256(k), 1, 24) AS ref_hash, count(DISTINCT a.u) AS a_units, count(DISTINCT b.u) AS b_units FROM a JOIN b USING (k) GROUP BY 1""")
def linked_cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are both cases and hold lines with outlying amounts."""
    from ..functions import base_amount

    gl = gl_of(spark, d)
    z = X.zscores(gl.select("row_id", "document_id", "gl_account", "debit_amount", "credit_amount"), base_amount(), "z").filter(F.round("z", 4) > 3)
    return C.linked(_case_table(spark, d).select(F.col("document_id").alias("unit_id"), "document_id"), z.select(F.col("row_id").alias("unit_id"), "document_id"), "document_id")


# ---- evaluation
@query(f"""
    WITH {_FLAGS}, f AS (SELECT DISTINCT rule_id, document_id FROM flags JOIN general_ledger USING (row_id) WHERE document_id IS NOT NULL), b AS (SELECT document_id FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1 HAVING abs(sum({DB} - {CR})) > 0.01),
    t AS (SELECT rule_id, document_id FROM (SELECT DISTINCT rule_id FROM f), b), j AS (SELECT coalesce(f.rule_id, t.rule_id) AS rule_id, f.document_id IS NOT NULL AS a, t.document_id IS NOT NULL AS b FROM f FULL JOIN t ON f.rule_id = t.rule_id AND f.document_id = t.document_id),
    g AS (SELECT rule_id, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE b AND NOT a) AS fn FROM j GROUP BY 1)
    SELECT rule_id, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall FROM g""")
def ground_truth_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each test's documents against labelled ones, here the unbalanced documents."""
    gl = gl_of(spark, d).filter("document_id is not null")
    f = written(_flags(spark, d).join(gl.select("row_id", "document_id"), "row_id").select("rule_id", "document_id").distinct(), "found")
    bad = gl.groupBy("document_id").agg(F.sum(F.coalesce("debit_amount", F.lit(0.0)) - F.coalesce("credit_amount", F.lit(0.0))).alias("off")).filter(F.abs("off") > 0.01).select("document_id")
    ids = F.array(*(F.lit(r["rule_id"]) for r in f.select("rule_id").distinct().collect()))  # as many as there are tests
    m = K.precision_recall(f, bad.select(F.explode(ids).alias("rule_id"), "document_id"))
    return m.select("rule_id", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_FOLDS = """x AS (SELECT row_id, theme_id, band, score, (('0x' || substring(md5(coalesce(theme_id, '') || ':42'), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM contract_v2_group_top_case_eval WHERE score IS NOT NULL AND NOT isnan(score)),
    r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC) AS i, count(*) OVER (PARTITION BY fold) AS fold_size FROM x), e AS (SELECT fold, greatest(1, floor(max(fold_size) * 0.01))::BIGINT AS k FROM r GROUP BY 1), t AS (SELECT r.fold, e.k, r.score AS edge FROM r JOIN e ON r.fold = e.fold AND r.i = e.k),
    rk AS (SELECT r.fold, band AS scenario, t.k, fold_size, count(*) AS n_truth, count(*) FILTER (WHERE score >= edge) AS n_hit FROM r JOIN t ON r.fold = t.fold WHERE band IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def _recall(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contract_v2_group_top_case_eval").filter("score is not null and not isnan(score)")
    return C.recall_at_k(c.select("row_id", "theme_id", F.col("band").alias("scenario"), "score"), "theme_id", "scenario", "score")


@query(f"WITH {_FOLDS} SELECT fold, scenario, k, fold_size, n_truth, n_hit, round(n_hit / n_truth, 9) AS recall FROM rk")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d).withColumn("recall", F.round("recall", 9))


@query(f"WITH {_FOLDS}, s AS (SELECT scenario, sum(n_truth)::BIGINT AS n_truth, sum(n_hit)::BIGINT AS n_hit FROM rk GROUP BY 1) SELECT *, round(n_hit / n_truth, 9) AS point_recall, true AS within FROM s")
def recall_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Recall with its bootstrap interval; within says that the interval holds it and is about as wide as the normal one."""
    b = C.bootstrap(_recall(spark, d).select("scenario", "n_truth", "n_hit"))
    p, n = F.col("point_recall"), F.col("n_truth")
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    ok = (F.col("ci_lo") <= p) & (p <= F.col("ci_hi")) & (F.abs((F.col("ci_hi") - F.col("ci_lo")) / 2 - half) <= 0.35 * half + 1.5 / n)
    return b.select("scenario", "n_truth", "n_hit", F.round(p, 9).alias("point_recall"), ok.alias("within"))


@query(f"""
    WITH s AS ({_SCORES}), g AS (SELECT document_id, bool_or(s.row_id IS NOT NULL) AS f, bool_or(coalesce(risk_level = 'High', false)) AS h FROM general_ledger LEFT JOIN s USING (row_id) WHERE document_id IS NOT NULL GROUP BY 1)
    SELECT count(*) AS total_docs, count(*) FILTER (WHERE f) AS flagged_docs, count(*) FILTER (WHERE h) AS high_risk_docs, count(*) FILTER (WHERE h) / count(*) AS high_risk_ratio FROM g""")
def operational_report(spark: SparkSession, d: str) -> DataFrame:
    return C.operational_report(gl_of(spark, d), K.row_scores(_flags(spark, d)))


@query(f"""
    WITH s AS ({_SCORES}) SELECT row_id, concat_ws(' | ', document_id, strftime(posting_date, '%Y-%m-%d'), gl_account, flagged_rules, risk_level) AS evidence FROM s JOIN general_ledger USING (row_id) WHERE risk_level = 'High'""")
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    s = K.row_scores(_flags(spark, d)).filter("risk_level = 'High'")
    x = gl_of(spark, d).join(s, "row_id")
    return x.select("row_id", F.concat_ws(" | ", "document_id", F.date_format("posting_date", "yyyy-MM-dd"), "gl_account", "flagged_rules", "risk_level").alias("evidence"))


# ---- reads of scored lines
@query(f"WITH s AS ({_SCORES}) SELECT coalesce(risk_level, 'Normal') AS risk_level, count(*) AS line_count, round(sum(debit_amount), 2) AS debit, round(sum(credit_amount), 2) AS credit FROM general_ledger LEFT JOIN s USING (row_id) GROUP BY 1")
def risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d)
    return x.groupBy("risk_level").agg(F.count(F.lit(1)).alias("line_count"), F.round(F.sum("debit_amount"), 2).alias("debit"), F.round(F.sum("credit_amount"), 2).alias("credit"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = K.row_scores(_flags(spark, d))
    return gl_of(spark, d).join(s, "row_id", "left").withColumns({"risk_level": F.coalesce("risk_level", F.lit("Normal")), "anomaly_score": F.coalesce("anomaly_score", F.lit(0.0))})


@query(f"WITH s AS ({_SCORES}) SELECT row_id, document_id, anomaly_score, risk_level, flagged_rules FROM general_ledger JOIN s USING (row_id) WHERE upload_batch_id = (SELECT min(upload_batch_id) FROM general_ledger) ORDER BY anomaly_score DESC, row_id LIMIT 1000")
def batch_lines(spark: SparkSession, d: str) -> DataFrame:
    """A load's scored lines, the 1,000 highest."""
    gl = gl_of(spark, d)
    x = gl.filter(F.col("upload_batch_id") == gl.agg(F.min("upload_batch_id")).first()[0]).join(K.row_scores(_flags(spark, d)), "row_id")
    return x.select("row_id", "document_id", "anomaly_score", "risk_level", "flagged_rules").orderBy(F.desc("anomaly_score"), "row_id").limit(1000)


@query(f"WITH {_FLAGS} SELECT row_id, rule_id, score FROM flags JOIN general_ledger USING (row_id) WHERE upload_batch_id = (SELECT min(upload_batch_id) FROM general_ledger)")
def batch_flags(spark: SparkSession, d: str) -> DataFrame:
    gl = gl_of(spark, d)
    return _flags(spark, d).join(gl.filter(F.col("upload_batch_id") == gl.agg(F.min("upload_batch_id")).first()[0]).select("row_id"), "row_id", "left_semi")


@query(f"WITH {_FLAGS}, m AS (SELECT min(document_id) AS m FROM general_ledger JOIN flags USING (row_id) WHERE rule_id = 'L3-02') SELECT row_id, line_number, rule_id, score FROM flags JOIN general_ledger USING (row_id) WHERE rule_id = 'L3-02' AND document_id = (SELECT m FROM m)")
def document_rule_detail(spark: SparkSession, d: str) -> DataFrame:
    x = _flags(spark, d).filter("rule_id = 'L3-02'").join(gl_of(spark, d).select("row_id", "document_id", "line_number"), "row_id")
    return x.filter(F.col("document_id") == x.agg(F.min("document_id")).first()[0]).select("row_id", "line_number", "rule_id", "score")


@query(f"WITH s AS ({_SCORES}) SELECT gl_account, count(*) AS flagged, round(avg(anomaly_score), 9) AS avg_score, round(sum(debit_amount), 2) AS debit FROM general_ledger JOIN s USING (row_id) WHERE anomaly_score > 0 AND gl_account IS NOT NULL GROUP BY 1 ORDER BY flagged DESC, gl_account LIMIT 10")
def accounts_with_most_flags(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d).filter("anomaly_score > 0 and gl_account is not null")
    return x.groupBy("gl_account").agg(F.count(F.lit(1)).alias("flagged"), F.round(F.avg("anomaly_score"), 9).alias("avg_score"), F.round(F.sum("debit_amount"), 2).alias("debit")).orderBy(F.desc("flagged"), "gl_account").limit(10)


@query(f"""
    WITH s AS ({_SCORES}) SELECT created_by, count(*) AS line_count, round(avg(coalesce(anomaly_score, 0)), 9) AS avg_score, round(avg(CASE WHEN contains(coalesce(flagged_rules, ''), 'L3-02') THEN 1.0 ELSE 0.0 END), 9) AS manual_rate, round(avg(CASE WHEN contains(coalesce(flagged_rules, ''), 'L3-06') THEN 1.0 ELSE 0.0 END), 9) AS late_rate
    FROM general_ledger LEFT JOIN s USING (row_id) WHERE created_by IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 ORDER BY avg_score DESC, created_by LIMIT 10""")
def users_by_risk(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d).filter("created_by is not null")
    rate = lambda r: F.round(F.avg(F.when(F.coalesce("flagged_rules", F.lit("")).contains(r), 1.0).otherwise(0.0)), 9)
    g = x.groupBy("created_by").agg(F.count(F.lit(1)).alias("line_count"), F.round(F.avg("anomaly_score"), 9).alias("avg_score"), rate("L3-02").alias("manual_rate"), rate("L3-06").alias("late_rate")).filter("line_count >= 20")
    return g.orderBy(F.desc("avg_score"), "created_by").limit(10)


@query(f"WITH {_FLAGS} SELECT coalesce(business_process, '-') AS process, rule_id, count(*) AS line_count, count(DISTINCT document_id) AS documents FROM flags JOIN general_ledger USING (row_id) GROUP BY 1, 2")
def rules_by_process(spark: SparkSession, d: str) -> DataFrame:
    x = _flags(spark, d).join(gl_of(spark, d).select("row_id", "document_id", "business_process"), "row_id")
    return x.groupBy(F.coalesce("business_process", F.lit("-")).alias("process"), "rule_id").agg(F.count(F.lit(1)).alias("line_count"), F.count_distinct("document_id").alias("documents"))


@query(f"""
    WITH s AS ({_SCORES}), x AS (SELECT g.document_id, coalesce(anomaly_score, 0) AS sc, flagged_rules, {BASE} AS b FROM general_ledger g LEFT JOIN s USING (row_id) WHERE document_id IS NOT NULL AND NOT {BLANK("approved_by")})
    SELECT document_id, max(sc) AS score, count(*) AS line_count, round(sum(b), 2) AS amount, max(coalesce(flagged_rules, '')) AS rules FROM x GROUP BY 1""")
def report_documents(spark: SparkSession, d: str) -> DataFrame:
    """What a report lists: approved lines by document, with the highest score."""
    from ..functions import base_amount

    x = _scored(spark, d).filter(F.col("document_id").isNotNull() & ~blank("approved_by")).withColumn("b", base_amount())
    return x.groupBy("document_id").agg(F.max("anomaly_score").alias("score"), F.count(F.lit(1)).alias("line_count"), F.round(F.sum("b"), 2).alias("amount"), F.max(F.coalesce("flagged_rules", F.lit(""))).alias("rules"))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
