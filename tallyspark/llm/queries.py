"""The queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read, spread, written
from . import digest, encode, mixing, neardup, pieces, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cases = spread(read(spark, d, "contract_v2_group_top_case_eval").select("theme_id", "case_id", "score"))
    return topn.top_n_per_group(cases, "theme_id", "score", "case_id", 3).select("theme_id", "case_id", "rank_no")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = neardup.ledger_documents(read(spark, d, "general_ledger"))
    return neardup.alike_pairs(docs).select(F.col("id_a").alias("document_id_a"), F.col("id_b").alias("document_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document and company. Documents without a company are no one's copies, so each stays alone but for its equals."""
    docs = neardup.ledger_documents(read(spark, d, "general_ledger"))
    return neardup.links_per_record(docs).select(F.col("id").alias("document_id"), "class_id", "n_links")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the forest finds where cells are crowded: all documents of a company are put into one cell, and the links of those whose number is divisible by 50 are held against all."""
    docs = neardup.ledger_documents(read(spark, d, "general_ledger")).withColumns({"day": F.lit(0), "amount": F.lit(1.0)})
    asked = F.pmod(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint"), F.lit(50)) == 0
    return neardup.recall(docs, asked).select("links", (F.col("found") >= 0.9 * F.col("links")).alias("enough"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return digest.heavy_tails(read(spark, d, "general_ledger"), "gl_account", F.col("local_amount"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = digest.exact_percentiles(read(spark, d, "general_ledger"), "gl_account", F.col("local_amount"), (1, 5, 25, 50, 75, 95, 99))
    return e.select("gl_account", F.col("percentile").cast("int").alias("percentile"), "n", "value")


def p6_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of each load, added up per account: the exact values read out of their brackets, and whether the estimates are within 1 % of the ranks, as the counting pass certifies."""
    gl = read(spark, d, "general_ledger").filter("gl_account is not null")
    per_load = digest.digests(gl.withColumn("of", F.to_json(F.struct("gl_account", F.coalesce("upload_batch_id", F.lit("")).alias("load")))), "of", F.col("local_amount"))
    parts = per_load.select(F.get_json_object("of", "$.gl_account").alias("gl_account"), "means", "weights", "low", "high")
    e = digest.exact_percentiles(gl, "gl_account", F.col("local_amount"), (50, 99), digest.merge(parts, "gl_account"))
    return e.select("gl_account", F.col("percentile").cast("int").alias("percentile"), "n", "value", (F.col("rank_error") <= 0.01 * F.col("n") + 1).alias("certified"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each text as its ids decode to it."""
    ids = encode.encode_corpus(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return encode.decode_corpus(ids, "doc_id", "ids").select("doc_id", F.md5("text").alias("text_md5"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.with_tokens(spread(read(spark, d, "documents").select("doc_id", "source", "text"))), read(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "mix_targets")
    tokens = mixing.with_tokens(spread(read(spark, d, "documents").select("doc_id", "source", "text")))
    return mixing.shares(written(mixing.mix(tokens, targets), "mix"), targets, tokens)


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source's share of the mix is within the bound of its weight, and no document is used more often than it may be."""
    docs, targets = mixing.with_tokens(spread(read(spark, d, "documents").select("doc_id", "source", "text"))), read(spark, d, "mix_targets")
    mixed = written(mixing.mix(docs, targets), "mix")
    weights = spark.createDataFrame([(r["source"], float(r["weight"])) for r in mixing.plan(docs, targets)], "source string, weight double")
    s = mixing.shares(mixed, targets, docs).join(F.broadcast(weights), "source").join(targets.select("source", "max_repeats"), "source")
    ok = (F.abs(F.col("actual_share") - F.col("weight")) <= F.col("bound") + 1e-9) & (F.col("most_copies") <= F.col("max_repeats"))
    return s.select("source", F.round("weight", 9).alias("weight"), ok.alias("kept"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p10_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return pieces.audit(docs, pieces.split_oversized(docs, "doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_classes, p3_recall, p6_found, p6_percentiles, p6_digest, p8_ids, p8_decoded, p9_mix, p9_shares, p9_bounds, p10_pieces, p10_audit)}


_DOCS = """
  docs AS (
    SELECT document_id AS id, company_code AS grp, min(posting_date::DATE) AS day, max(CASE WHEN NOT isnan(local_amount) THEN local_amount END) AS amount,
           max(coalesce(header_text, '') || ' ' || coalesce(reference, '')) AS text
    FROM general_ledger WHERE document_id IS NOT NULL GROUP BY 1, 2),
  tidied AS (SELECT id, grp, day, amount, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text FROM docs)"""
_SETS = lambda of: f"sets AS (SELECT *, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS s FROM {of} WHERE length(text) >= 3 AND amount > 0 AND day IS NOT NULL AND grp IS NOT NULL)"
_CLASSES = f"classes AS (SELECT min(id) AS id, grp, day, amount, text FROM tidied GROUP BY 2, 3, 4, 5), {_SETS('classes')}"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH best AS (SELECT theme_id, case_id, max(score) AS score FROM contract_v2_group_top_case_eval
                          WHERE theme_id IS NOT NULL AND case_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
                 ranked AS (SELECT theme_id, case_id, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, case_id) AS r FROM best)
            SELECT theme_id, case_id, r::INTEGER AS rank_no FROM ranked WHERE r <= 3""",
        "p3_found": f"""
            WITH {_DOCS}, {_SETS("tidied")},
              near AS (
                SELECT a.id AS document_id_a, b.id AS document_id_b, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS c
                FROM sets a JOIN sets b ON a.grp = b.grp AND a.id < b.id AND b.day BETWEEN a.day - 7 AND a.day + 7
                 AND abs(a.amount - b.amount) <= 0.02 * greatest(a.amount, b.amount))
            SELECT document_id_a, document_id_b FROM near WHERE c >= 0.5 * (n - c)""",
        "p3_classes": f"""
            WITH {_DOCS}, {_CLASSES},
              near AS (SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.grp = b.grp AND a.id < b.id AND b.day BETWEEN a.day - 7 AND a.day + 7 AND abs(a.amount - b.amount) <= 0.02 * greatest(a.amount, b.amount)
                       WHERE len(list_intersect(a.s, b.s)) >= 0.5 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
              n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM near UNION ALL SELECT b FROM near) GROUP BY 1)
            SELECT t.id AS document_id, c.id AS class_id, coalesce(n.n, 0) AS n_links FROM tidied t JOIN classes c ON t.grp IS NOT DISTINCT FROM c.grp AND t.day IS NOT DISTINCT FROM c.day AND t.amount IS NOT DISTINCT FROM c.amount AND t.text = c.text LEFT JOIN n ON n.id = c.id""",
        "p3_recall": f"""
            WITH {_DOCS.replace("min(posting_date::DATE)", "DATE '1970-01-01'").replace("max(CASE WHEN NOT isnan(local_amount) THEN local_amount END)", "1.0")}, {_CLASSES},
              q AS (SELECT * FROM sets WHERE try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0)
            SELECT count(*) AS links, true AS enough FROM q JOIN sets b ON q.grp = b.grp AND q.id <> b.id WHERE len(list_intersect(q.s, b.s)) >= 0.5 * (len(q.s) + len(b.s) - len(list_intersect(q.s, b.s)))""",
        "p6_digest": """
            WITH r AS (SELECT gl_account, local_amount AS v, row_number() OVER (PARTITION BY gl_account ORDER BY local_amount) AS k, count(*) OVER (PARTITION BY gl_account) AS n
                       FROM general_ledger WHERE gl_account IS NOT NULL AND local_amount IS NOT NULL AND NOT isnan(local_amount)),
                 p AS (SELECT unnest([50, 99])::INTEGER AS percentile)
            SELECT gl_account, percentile, n, v AS value, true AS certified FROM r JOIN p ON k = (n * percentile + 99) // 100""",
        "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "p9_bounds": """
            WITH d AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND length(text) > 0), t AS (SELECT m.source, max(target_share) AS s, max(max_repeats) AS r, count(d.source) > 0 AND coalesce(max(max_repeats), 1) > 0 AS present FROM mix_targets m LEFT JOIN d USING (source) WHERE m.source IS NOT NULL AND target_share > 0 GROUP BY 1)
            SELECT source, round(CASE WHEN present THEN s / (SELECT sum(s) FROM t WHERE present) ELSE 0 END, 9) AS weight, true AS kept FROM t""",
        "p10_audit": "SELECT 0::BIGINT AS over_limit, 0::BIGINT AS altered, 0::BIGINT AS gaps, 0::BIGINT AS unordered, 0::BIGINT AS unlapped, 0::BIGINT AS unfinished",
        "p6_found": """
            WITH v AS (SELECT gl_account, abs(local_amount) AS a FROM general_ledger WHERE gl_account IS NOT NULL AND local_amount IS NOT NULL AND NOT isnan(local_amount)),
                 r AS (SELECT gl_account, a, row_number() OVER (PARTITION BY gl_account ORDER BY a) AS k, count(*) OVER (PARTITION BY gl_account) AS n FROM v)
            SELECT gl_account FROM r GROUP BY gl_account, n
            HAVING n >= 20 AND max(CASE WHEN k = (n * 99 + 99) // 100 THEN a END) > 50 * max(CASE WHEN k = (n * 50 + 99) // 100 THEN a END)""",
        "p6_percentiles": """
            WITH r AS (SELECT gl_account, local_amount AS v, row_number() OVER (PARTITION BY gl_account ORDER BY local_amount) AS k, count(*) OVER (PARTITION BY gl_account) AS n
                       FROM general_ledger WHERE gl_account IS NOT NULL AND local_amount IS NOT NULL AND NOT isnan(local_amount)),
                 p AS (SELECT unnest([1, 5, 25, 50, 75, 95, 99])::INTEGER AS percentile)
            SELECT gl_account, percentile, n, v AS value FROM r JOIN p ON k = (n * percentile + 99) // 100""",
    }
