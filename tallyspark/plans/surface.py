"""The SQL surface: views by name, preset statements, a guard for ad-hoc SELECTs, and filter composition."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from .ledger import BASE, BLANK, C, D, Query

TABLES = ("general_ledger", "employees", "purchase_order_headers", "goods_receipt_headers", "vendor_invoice_headers", "payment_allocations")
#: Tables beside those that ad-hoc statements may read.
OWN_TABLES = (*TABLES, "contract_v2_group_top_case_eval")

#: Preset statements; each runs as it is on Spark, and on other engines of the same dialect.
PRESETS = {
    "batch_ledger": "SELECT upload_batch_id, count(*) AS line_count, count(DISTINCT document_id) AS documents, min(posting_date) AS first_posting, max(posting_date) AS last_posting FROM general_ledger GROUP BY upload_batch_id",
    "top_accounts": f"SELECT gl_account, count(*) AS line_count, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE gl_account IS NOT NULL GROUP BY gl_account ORDER BY amount DESC, gl_account LIMIT 10",
    "three_way_match": """
        WITH po AS (SELECT document_id, min(total_net_amount) AS po_net, count(*) AS po_rows FROM purchase_order_headers WHERE document_id IS NOT NULL GROUP BY document_id),
        gr AS (SELECT purchase_order_id, sum(total_value) AS gr_value, count(*) AS gr_rows FROM goods_receipt_headers WHERE purchase_order_id IS NOT NULL GROUP BY purchase_order_id),
        vi AS (SELECT purchase_order_id, sum(net_amount) AS vi_net, count(*) AS vi_rows FROM vendor_invoice_headers WHERE purchase_order_id IS NOT NULL GROUP BY purchase_order_id)
        SELECT po.document_id, po_net, round(gr_value, 2) AS gr_value, round(vi_net, 2) AS vi_net, round(abs(coalesce(po_net, 0) - coalesce(vi_net, 0)), 2) AS po_vi_difference, round(abs(coalesce(gr_value, 0) - coalesce(vi_net, 0)), 2) AS gr_vi_difference
        FROM po LEFT JOIN gr ON gr.purchase_order_id = po.document_id LEFT JOIN vi ON vi.purchase_order_id = po.document_id""",
    "document_flow": """
        SELECT v.document_id AS invoice_id, v.purchase_order_id, v.goods_receipt_id, p.document_id AS payment_id, p.amount FROM (SELECT DISTINCT document_id, purchase_order_id, goods_receipt_id FROM vendor_invoice_headers WHERE document_id IS NOT NULL) v
        JOIN (SELECT DISTINCT document_id, invoice_id, amount FROM payment_allocations WHERE invoice_id IS NOT NULL) p ON p.invoice_id = v.document_id""",
    "ledger_links": "SELECT g.document_id, g.reference, v.document_id AS invoice_id FROM (SELECT DISTINCT document_id, reference FROM general_ledger WHERE reference IS NOT NULL) g JOIN (SELECT DISTINCT document_id, vendor_invoice_number FROM vendor_invoice_headers WHERE vendor_invoice_number IS NOT NULL) v ON upper(trim(g.reference)) = upper(trim(v.vendor_invoice_number))",
    "employee_details": "SELECT DISTINCT employee_id, user_id, persona, department_id, approval_limit FROM employees WHERE user_id IS NOT NULL",
    "manual_by_process": "SELECT coalesce(business_process, '-') AS process, count(*) AS line_count, CAST(sum(CASE WHEN lower(trim(source)) = 'manual' THEN 1 ELSE 0 END) AS BIGINT) AS manual, round(avg(CASE WHEN lower(trim(source)) = 'manual' THEN 1e0 ELSE 0e0 END), 6) AS manual_share FROM general_ledger GROUP BY coalesce(business_process, '-')",
    "suspense_candidates": "SELECT substring(gl_account, 1, 3) AS prefix, count(*) AS line_count, round(avg(CASE WHEN lower(line_text) LIKE '%settlement%' OR lower(line_text) LIKE '%accrual%' THEN 1e0 ELSE 0e0 END), 6) AS share FROM general_ledger WHERE gl_account IS NOT NULL GROUP BY substring(gl_account, 1, 3) HAVING count(*) >= 3 AND avg(CASE WHEN lower(line_text) LIKE '%settlement%' OR lower(line_text) LIKE '%accrual%' THEN 1e0 ELSE 0e0 END) >= 0.2",
    "revenue_prefixes": f"SELECT substring(gl_account, 1, 2) AS prefix, round(sum({C} - {D}), 2) AS net FROM general_ledger WHERE gl_account LIKE '4%' GROUP BY substring(gl_account, 1, 2) ORDER BY net DESC, prefix LIMIT 5",
    "account_pairs": f"""
        WITH d AS (SELECT DISTINCT document_id, gl_account FROM general_ledger WHERE {D} > 0 AND gl_account IS NOT NULL AND document_id IS NOT NULL), c AS (SELECT DISTINCT document_id, gl_account FROM general_ledger WHERE {C} > 0 AND gl_account IS NOT NULL AND document_id IS NOT NULL)
        SELECT d.gl_account AS debit_account, c.gl_account AS credit_account, count(*) AS documents FROM d JOIN c ON d.document_id = c.document_id GROUP BY d.gl_account, c.gl_account""",
    "weekend_midnight": "SELECT document_id, count(*) AS line_count FROM general_ledger WHERE document_id IS NOT NULL AND (weekday(posting_date) IN (5, 6) OR hour(posting_date) >= 22 OR hour(posting_date) < 6) GROUP BY document_id",
    "common_documents": "SELECT document_id FROM general_ledger WHERE gl_account = '183247' AND document_id IS NOT NULL INTERSECT SELECT document_id FROM general_ledger WHERE gl_account = '101278'",
    "monthly_sales": f"SELECT CAST(fiscal_year AS VARCHAR) AS fiscal_year, CAST(fiscal_period AS VARCHAR) AS fiscal_period, count(*) AS line_count, round(sum(CASE WHEN gl_account LIKE '4%' THEN {C} - {D} ELSE 0 END), 2) AS net_sales FROM general_ledger GROUP BY fiscal_year, fiscal_period",
    "year_over_year": f"""
        WITH a AS (SELECT gl_account, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE fiscal_year = 2023 AND gl_account IS NOT NULL GROUP BY gl_account), b AS (SELECT gl_account, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE fiscal_year = 2024 AND gl_account IS NOT NULL GROUP BY gl_account)
        SELECT coalesce(a.gl_account, b.gl_account) AS gl_account, coalesce(a.amount, 0) AS before_amount, coalesce(b.amount, 0) AS after_amount FROM a FULL OUTER JOIN b ON a.gl_account = b.gl_account""",
    "compare_loads": f"""
        SELECT company_code, 'early' AS side, count(*) AS line_count, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE posting_date < TIMESTAMP '2024-01-01 00:00:00' GROUP BY company_code
        UNION ALL SELECT company_code, 'late' AS side, count(*) AS line_count, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE posting_date >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY company_code""",
    "user_activity": f"""
        SELECT lower(trim(created_by)) AS user_name, count(*) AS line_count, count(DISTINCT document_id) AS documents, round(avg(CASE WHEN hour(posting_date) >= 22 OR hour(posting_date) < 6 THEN 1e0 ELSE 0e0 END), 6) AS late_share, round(avg({BASE}), 2) AS mean_amount
        FROM general_ledger WHERE created_by IS NOT NULL GROUP BY lower(trim(created_by))""",
    "period_end_large": f"""
        SELECT row_id, document_id, gl_account, {BASE} AS amount FROM general_ledger WHERE (datediff(last_day(CAST(posting_date AS DATE)), CAST(posting_date AS DATE)) <= 5 OR day(posting_date) <= 5) AND {BASE} >= 50000 ORDER BY amount DESC, row_id LIMIT 1000""",
    "digit_shares": f"""
        WITH x AS (SELECT substring(CAST(CAST({BASE} AS BIGINT) AS VARCHAR), 1, 1) AS digit FROM general_ledger WHERE {BASE} >= 1), n AS (SELECT digit, count(*) AS c FROM x GROUP BY digit)
        SELECT digit, c AS line_count, round(c / (SELECT sum(c) FROM n), 6) AS observed, round(log10(1 + 1e0 / CAST(digit AS DOUBLE)), 6) AS expected FROM n""",
    "intercompany_check": f"""
        SELECT company_code, trading_partner, round(sum({D}), 2) AS debit, round(sum({C}), 2) AS credit, round(sum({D} - {C}), 2) AS net FROM general_ledger WHERE lower(trim(business_process)) = 'intercompany' OR lower(trim(document_type)) = 'ic' GROUP BY company_code, trading_partner""",
    "suspense_aging": f"""
        SELECT gl_account, CASE WHEN {BLANK("reference")} THEN 'open' ELSE 'cleared' END AS state, count(*) AS line_count, round(sum({D}), 2) AS debit FROM general_ledger WHERE gl_account LIKE '19%' OR gl_account LIKE '29%' OR lower(line_text) LIKE '%suspense%' OR lower(line_text) LIKE '%clearing%'
        GROUP BY gl_account, CASE WHEN {BLANK("reference")} THEN 'open' ELSE 'cleared' END""",
    "process_users": "SELECT lower(trim(created_by)) AS user_name, count(DISTINCT business_process) AS processes, count(*) AS line_count FROM general_ledger WHERE created_by IS NOT NULL AND business_process IS NOT NULL GROUP BY lower(trim(created_by)) HAVING count(DISTINCT business_process) > 2",
    "manual_texts": "SELECT header_text, count(*) AS line_count FROM general_ledger WHERE lower(trim(source)) = 'manual' AND header_text IS NOT NULL GROUP BY header_text ORDER BY line_count DESC, header_text LIMIT 20",
    "account_list": f"SELECT gl_account, count(*) AS line_count, count(DISTINCT document_id) AS documents, min(posting_date) AS first_posting, max(posting_date) AS last_posting, round(sum({BASE}), 2) AS amount FROM general_ledger WHERE gl_account IS NOT NULL GROUP BY gl_account",
    "yearly_estimates": f"SELECT CAST(fiscal_year AS VARCHAR) AS fiscal_year, gl_account, round(sum({D} - {C}), 2) AS net, count(*) AS line_count FROM general_ledger WHERE substring(gl_account, 1, 2) IN ('15', '16', '25', '26') GROUP BY fiscal_year, gl_account",
    "vendor_details": "SELECT vendor_id, count(DISTINCT document_id) AS invoices, round(sum(gross_amount), 2) AS gross, CAST(sum(CASE WHEN is_paid THEN 1 ELSE 0 END) AS BIGINT) AS paid FROM vendor_invoice_headers WHERE vendor_id IS NOT NULL GROUP BY vendor_id",
    "label_stats": "SELECT theme_label, band, count(*) AS cases, round(avg(CAST(doc_count AS DOUBLE)), 6) AS mean_documents, round(avg(CAST(rule_count AS DOUBLE)), 6) AS mean_rules FROM contract_v2_group_top_case_eval GROUP BY theme_label, band",
    "latest_report": "SELECT case_id, row_id, band FROM contract_v2_group_top_case_eval WHERE evaluated_at IS NOT NULL ORDER BY evaluated_at DESC, row_id DESC LIMIT 1",
    "report_rules": "SELECT theme_id, sum(rule_count) AS rules, max(doc_count) AS documents FROM contract_v2_group_top_case_eval WHERE theme_id IS NOT NULL GROUP BY theme_id",
    "queue_rows": "SELECT row_id, case_id, coalesce(rank, 999999) AS place FROM contract_v2_group_top_case_eval WHERE band IS NOT NULL ORDER BY coalesce(rank, 999999), row_id LIMIT 500",
    "materiality": f"""
        SELECT company_code, round(sum(CASE WHEN gl_account LIKE '4%' AND NOT coalesce(lower(header_text), '') LIKE '%closing%' THEN {C} - {D} ELSE 0 END), 2) AS revenue, round(sum(CASE WHEN (gl_account LIKE '5%' OR gl_account LIKE '6%') AND NOT coalesce(lower(header_text), '') LIKE '%closing%' THEN {D} - {C} ELSE 0 END), 2) AS expense
        FROM general_ledger GROUP BY company_code""",
    "process_stats": f"SELECT coalesce(business_process, '-') AS process, count(*) AS line_count, count(DISTINCT document_id) AS documents, round(sum({BASE}), 2) AS amount, round(avg({BASE}), 4) AS mean_amount FROM general_ledger GROUP BY coalesce(business_process, '-')",
    "overview": f"""
        SELECT count(*) AS line_count, count(DISTINCT document_id) AS documents, count(DISTINCT gl_account) AS accounts, count(DISTINCT created_by) AS users, count(DISTINCT trading_partner) AS partners, count(DISTINCT company_code) AS companies, round(sum({D}), 2) AS debit, round(sum({C}), 2) AS credit,
        CAST(sum(CASE WHEN {BLANK("approved_by")} THEN 1 ELSE 0 END) AS BIGINT) AS unapproved, datediff(max(CAST(posting_date AS DATE)), min(CAST(posting_date AS DATE))) AS days FROM general_ledger""",
}


#: Where another engine spells a function differently.
OTHER_DIALECT = {
    "weekend_midnight": PRESETS["weekend_midnight"].replace("weekday(posting_date) IN (5, 6)", "isodow(posting_date) IN (6, 7)"),
    "period_end_large": PRESETS["period_end_large"].replace("datediff(last_day(CAST(posting_date AS DATE)), CAST(posting_date AS DATE))", "date_diff('day', CAST(posting_date AS DATE), last_day(CAST(posting_date AS DATE)))"),
    "digit_shares": PRESETS["digit_shares"].replace("CAST(CAST(", "CAST(CAST(trunc(").replace(" AS BIGINT) AS VARCHAR)", ") AS BIGINT) AS VARCHAR)"),
    "overview": PRESETS["overview"].replace("datediff(max(CAST(posting_date AS DATE)), min(CAST(posting_date AS DATE)))", "max(CAST(posting_date AS DATE)) - min(CAST(posting_date AS DATE))"),
}


def spark_sql(text: str) -> str:
    """The shared fragments use casts and trims in a form that Spark spells otherwise."""
    text = re.sub(r"(\w+)::(\w+)", r"CAST(\1 AS \2)", text).replace(" AS VARCHAR)", " AS STRING)")
    return re.sub(r"trim\(([^(),]*(?:\([^()]*\))?), ' '\)", r"trim(\1)", text)


def views(spark: SparkSession, d: str, tables: Iterable[str] = OWN_TABLES) -> None:
    for t in tables:
        read(spark, d, t).createOrReplaceTempView(t)


def preset(spark: SparkSession, d: str, name: str) -> DataFrame:
    views(spark, d)
    return spark.sql(spark_sql(PRESETS[name]))


class Rejected(ValueError):
    """A statement that may not run."""


def guarded(spark: SparkSession, sql: str, allowed: Iterable[str] = TABLES, must_filter: str | None = "upload_batch_id", limit: int = 1000, depth: int = 3) -> DataFrame:
    """Run an ad-hoc SELECT: read-only, only over allowed tables, nested at most so deep, and limited. Every mention of a table that has the column must_filter stands under a condition that names loads: one of the
    parts joined by AND in a WHERE above it compares the column with a literal by = or IN. A condition on a qualified column holds for the table of that alias alone.

    The checks are made on the parsed plan, so words within strings or comments mean nothing."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"cannot be parsed: {str(e).splitlines()[0]}") from e
    allowed = {t.lower() for t in allowed}
    loose: set[str] = set()
    # a node to visit with: its depth, the names of common tables in scope, the alias it stands under, and the aliases (or "*") for which loads are named above it
    todo = [(plan, 0, frozenset(), None, frozenset())]
    while todo:
        node, at, ctes, alias, named = todo.pop()
        kind = node.getClass().getSimpleName()
        if at > depth:
            raise Rejected("nested too deep")
        if kind.startswith(("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "Set", "Add", "Replace", "Refresh", "Cache", "Uncache", "Load", "Rename", "Describe", "Show", "Explain", "Analyze")):
            raise Rejected(f"not a SELECT: {kind}")
        if kind == "UnresolvedRelation":
            name = node.tableName().lower().replace("`", "")
            if name in ctes:
                continue
            if name not in allowed:
                raise Rejected(f"a table that may not be read: {name}")
            if must_filter and not named & {"*", alias or name} and must_filter in spark.table(name).columns:
                loose.add(name)
        if kind == "UnresolvedWith":
            for k in range(node.cteRelations().size()):
                todo.append((node.cteRelations().apply(k).productElement(1), at, ctes, None, frozenset()))
                ctes = ctes | {_first(node.cteRelations().apply(k)).lower()}
        if kind == "Filter" and must_filter:
            named = named | _named(node.condition(), must_filter)
        if kind == "SubqueryAlias":
            inner = node.child().getClass().getSimpleName()
            alias = node.alias().lower() if inner == "UnresolvedRelation" else None
            nested = inner not in ("UnresolvedRelation", "Project", "Aggregate") or alias is None
            # what is said of a subquery's column says nothing of the tables within
            named = named if alias else frozenset()
            todo += [(c, at + nested, ctes, alias, named) for c in _plans(node)]
            continue
        if kind in ("Union", "Intersect", "Except", "Distinct"):
            todo += [(c, at, ctes, None, named if kind == "Distinct" else frozenset()) for c in _plans(node)]
        else:
            todo += [(c, at, ctes, None, named) for c in _plans(node)]
        exprs = node.expressions()
        for k in range(exprs.size()):
            todo += [(p, at + 1, ctes, None, frozenset()) for p in _subplans(exprs.apply(k))]
    if loose:
        raise Rejected(f"no predicate on {must_filter} for {sorted(loose)}")
    df = spark.sql(sql)
    df._jdf.queryExecution().assertAnalyzed()
    return df.limit(limit)


def _plans(node) -> list:
    out = []
    for part in (node.children(), node.innerChildren()):
        for k in range(part.size()):
            child = part.apply(k)
            if hasattr(child, "getClass") and ("plans.logical" in child.getClass().getName() or child.getClass().getSimpleName() in ("UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving")):
                out.append(child)
    return out


def _named(cond, column: str) -> frozenset[str]:
    """The aliases (or "*") for which a condition names values of the column."""
    kind = cond.getClass().getSimpleName()
    if kind == "And":
        return _named(cond.left(), column) | _named(cond.right(), column)
    if kind == "EqualTo":
        sides = [(cond.left(), [cond.right()]), (cond.right(), [cond.left()])]
    elif kind == "In":
        sides = [(cond.value(), [cond.list().apply(k) for k in range(cond.list().size())])]
    else:
        return frozenset()
    for attr, values in sides:
        if attr.getClass().getSimpleName() == "UnresolvedAttribute" and all(v.getClass().getSimpleName() == "Literal" for v in values):
            parts = [attr.nameParts().apply(k).lower() for k in range(attr.nameParts().size())]
            if parts[-1] == column and len(parts) <= 2:
                return frozenset({parts[0] if len(parts) == 2 else "*"})
    return frozenset()


def _first(pair) -> str:
    return str(pair.productElement(0))


def _subplans(expr) -> list:
    out = []
    if hasattr(expr, "plan") and expr.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        out.append(expr.plan())
    kids = expr.children()
    for k in range(kids.size()):
        out += _subplans(kids.apply(k))
    return out


def where(companies: list[str] | None = None, accounts: list[str] | None = None, since=None, until=None, least: float | None = None) -> Column:
    """The predicate of a report's filters; what is not given does not restrict."""
    c = F.lit(True)
    if companies:
        c = c & F.col("company_code").isin(companies)
    if accounts:
        c = c & F.col("gl_account").isin(accounts)
    if since is not None:
        c = c & (F.col("posting_date") >= F.lit(since))
    if until is not None:
        c = c & (F.col("posting_date") < F.lit(until))
    if least is not None:
        c = c & (F.greatest(F.coalesce("debit_amount", F.lit(0.0)), F.coalesce("credit_amount", F.lit(0.0))) >= least)
    return c


def _run(name: str) -> Query:
    return lambda spark, d: preset(spark, d, name)


#: Statements that the guard must let through or refuse; {g} stands for a read of the ledger.
GUARDED = (
    ("{g} WHERE upload_batch_id = 'a'", True), ("{g} g WHERE g.upload_batch_id IN ('a', 'b') AND row_id > 0", True), ("{g}", False), ("{g} WHERE 'upload_batch_id' = 'upload_batch_id'", False), ("{g} WHERE upload_batch_id = upload_batch_id OR true", False),
    ("{g} WHERE upload_batch_id = 'a' UNION ALL {g}", False), ("DROP TABLE general_ledger", False), ("SELECT * FROM secrets", False), ("WITH x AS ({g} WHERE upload_batch_id = 'a') SELECT count(*) FROM x", True), ("SELECT * FROM payment_allocations", True),
)


def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """(statement, accepted) of GUARDED."""
    views(spark, d)
    out = []
    for text, _ in GUARDED:
        try:
            guarded(spark, text.format(g="SELECT * FROM general_ledger"))
            out.append((text, True))
        except Rejected:
            out.append((text, False))
    return spark.createDataFrame(out, "statement string, accepted boolean")


def queries() -> dict[str, Query]:
    return {f"sql_{k}": _run(k) for k in PRESETS} | {"sql_guard_verdicts": guard_verdicts}


def oracle_sql() -> dict[str, str]:
    verdicts = ", ".join("('" + t.replace("'", "''") + f"', {str(ok).lower()})" for t, ok in GUARDED)
    return {f"sql_{k}": OTHER_DIALECT.get(k, s) for k, s in PRESETS.items()} | {"sql_guard_verdicts": f"SELECT * FROM (VALUES {verdicts}) t(statement, accepted)"}
