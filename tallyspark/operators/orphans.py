"""References to records that do not exist.

The distinct non-null keys of a referring table are held against the keys of the table referred to: those that a left anti-join
leaves are missing, the others are judged by what the records there say. Each side is aggregated to one row per key first, so a key that a
third of the rows carry moves once. Only the keys that fail for some row are joined back to the rows, heavy ones apart.

Defined results: keys compare trimmed and in lower case; null and blank references are none; a key with several parent
rows is valid if any of them is; a null created_at on either side is never late; an empty parent table makes every
reference missing; repeated rows are reported each by its row_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import joined_by_key


@dataclass(frozen=True)
class Reference:
    table: str
    key: str
    period: str  # the date column whose month is reported
    parent: str
    parent_key: str
    created: str = "created_at"
    row_id: str = "row_id"


LEDGER_REFERENCES = (
    Reference("payment_allocations", "invoice_id", "created_at", "vendor_invoice_headers", "document_id"),
    Reference("goods_receipt_headers", "purchase_order_id", "posting_date", "purchase_order_headers", "document_id"),
    Reference("general_ledger", "approved_by", "posting_date", "employees", "user_id"),
)


def plain_key(c: Column) -> Column:
    """Trimmed (white space of any kind) and lower-cased; null if nothing is left."""
    t = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", ""))
    return F.when(t != "", t)


def failing_keys(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(key, state, valid_from) for keys some of whose rows fail. child: (key, created); parent: (key, status, created)."""
    # written, so that the referring table is read once for both joins
    refs = written(child.filter("key is not null").groupBy("key").agg(F.min("created").alias("first_use")), "references")
    alive = F.coalesce(F.col("status") != "deleted", F.lit(True))
    have = written(parent.filter("key is not null").groupBy("key").agg(
        F.count(F.when(alive, 1)).alias("alive"),
        F.count(F.when(alive & F.col("created").isNull(), 1)).alias("undated"),
        F.min(F.when(alive, F.col("created"))).alias("first"),
    ), "parents")
    missing = refs.join(have, "key", "left_anti").select("key", F.lit("missing").alias("state"), F.lit(None).cast(parent.schema["created"].dataType).alias("valid_from"))
    state = F.when(F.col("alive") == 0, "deleted").when((F.col("undated") == 0) & (F.col("first_use") < F.col("first")), "late")
    return missing.unionByName(refs.join(have, "key").select("key", state.alias("state"), F.col("first").alias("valid_from")).filter("state is not null"))


def orphans(child: DataFrame, parent: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, ref_period, row_id, reason), one row per referring row that meets no valid record."""
    c = child.select(F.col(ref.row_id).alias("row_id"), plain_key(F.col(ref.key)).alias("key"), F.col(ref.created).alias("created"), F.col(ref.period).alias("period"))
    status = F.lower(F.regexp_replace(F.col("status"), r"\s+", "")) if "status" in parent.columns else F.lit(None).cast("string")
    p = parent.select(plain_key(F.col(ref.parent_key)).alias("key"), status.alias("status"), F.col(ref.created).alias("created"))
    hit = joined_by_key(c.filter("key is not null"), failing_keys(c, p), ["key"])
    late = (F.col("state") != "late") | (F.col("created") < F.col("valid_from"))
    return hit.filter(late).select(
        F.lit(ref.table).alias("table_name"), F.coalesce(F.date_format("period", "yyyy-MM"), F.lit("unknown")).alias("ref_period"), "row_id", F.col("state").alias("reason")
    )


def counts_per_period(found: DataFrame) -> DataFrame:
    return found.groupBy("table_name", "ref_period", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
