"""Queries of the streaming extension: the ledger is read as a stream until its end and what is written in append mode is compared, so windows count once the watermark has passed them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from ..streaming import ledger as S
from .ledger import BLANK, Query, gl_of

_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _until_end(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs make() over the dated lines as a stream, one file of them after another, until all are read."""
    at = new_path(spark, "stream")
    gl = gl_of(spark, d).filter("posting_date is not null").select("row_id", "document_id", "line_number", "gl_account", "created_by", F.col("posting_date").cast("timestamp").alias("at"))
    gl.write.parquet(f"{at}/in")
    out = make(spark.readStream.schema(gl.schema).parquet(f"{at}/in"))
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


_T = "t AS (SELECT *, max(posting_date) OVER () AS top FROM general_ledger WHERE posting_date IS NOT NULL)"


@query(f"WITH {_T} SELECT strftime(posting_date::DATE, '%Y-%m-%d') AS day, gl_account, count(*) AS n FROM t WHERE date_trunc('day', posting_date) + INTERVAL 1 DAY <= top - INTERVAL 1 DAY GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _until_end(spark, d, lambda s: S.daily_counts(s, "at", ["gl_account"]))
    return x.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "gl_account", "n")


@query(f"""
    WITH {_T}, x AS (SELECT unnest(range(1, 8)) AS k, date_trunc('day', posting_date) AS day, created_by, top FROM t WHERE NOT {BLANK("created_by")})
    SELECT strftime(day + to_days(k::INTEGER), '%Y-%m-%d') AS until, created_by, count(*) AS n FROM x WHERE day + to_days(k::INTEGER) <= top - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_trailing_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _until_end(spark, d, lambda s: S.trailing_counts(s.filter("trim(created_by) <> ''"), "at", ["created_by"]))
    return x.select(F.date_format("until", "yyyy-MM-dd").alias("until"), "created_by", "n")


@query(f"WITH {_T} SELECT strftime(date_trunc('second', posting_date), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM t WHERE date_trunc('second', posting_date) + INTERVAL 1 SECOND <= top - INTERVAL 1 HOUR GROUP BY date_trunc('second', posting_date) HAVING count(*) >= 4")
def stream_simultaneous(spark: SparkSession, d: str) -> DataFrame:
    x = _until_end(spark, d, lambda s: S.simultaneous(s, "at", 4))
    return x.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "n")


@query(f"""
    WITH {_T}, x AS (SELECT created_by, posting_date AS p, top, posting_date - lag(posting_date) OVER (PARTITION BY created_by ORDER BY posting_date, row_id) >= INTERVAL 30 MINUTE AS new, row_id FROM t WHERE created_by IS NOT NULL), y AS (SELECT *, sum(coalesce(new, true)::INTEGER) OVER (PARTITION BY created_by ORDER BY p, row_id ROWS UNBOUNDED PRECEDING) AS s FROM x)
    SELECT created_by, strftime(min(p), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n FROM y GROUP BY created_by, s HAVING max(p) + INTERVAL 30 MINUTE <= max(top) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = _until_end(spark, d, lambda s: S.sessions(s.filter("created_by is not null"), "at", "created_by"))
    return x.select("created_by", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "n")


@query("SELECT DISTINCT document_id, line_number, gl_account FROM general_ledger WHERE posting_date IS NOT NULL")
def stream_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _until_end(spark, d, lambda s: S.without_repeats(s, "at", ["document_id", "line_number", "gl_account"], "10000 days")).select("document_id", "line_number", "gl_account")


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
