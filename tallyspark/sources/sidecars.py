"""Files that come beside a ledger: nested documents, masters, sub-ledgers, labels. Each is read when it is there; what is not is an empty result for its name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import flow_tables, read_text


@dataclass(frozen=True)
class Sidecar:
    name: str
    path: str
    nested: bool = False  # documents with a header, items and references


#: The files by name.
SIDECARS = (
    Sidecar("purchase_orders", "document_flows/purchase_orders.json", True), Sidecar("goods_receipts", "document_flows/goods_receipts.json", True), Sidecar("vendor_invoices", "document_flows/vendor_invoices.json", True),
    Sidecar("payments", "document_flows/payments.json", True), Sidecar("sales_orders", "document_flows/sales_orders.json", True), Sidecar("deliveries", "document_flows/deliveries.json", True),
    Sidecar("customer_invoices", "document_flows/customer_invoices.json", True), Sidecar("document_references", "document_flows/document_references.json"), Sidecar("vendors", "master_data/vendors.json"),
    Sidecar("customers", "master_data/customers.json"), Sidecar("employees", "master_data/employees.json"), Sidecar("materials", "master_data/materials.json"), Sidecar("fixed_assets", "master_data/fixed_assets.json"),
    Sidecar("anomaly_labels", "labels/anomaly_labels.json"), Sidecar("subledger_ap", "subledger/ap_invoices.json"), Sidecar("subledger_ar", "subledger/ar_invoices.json"), Sidecar("ic_matched_pairs", "intercompany/ic_matched_pairs.json"),
    Sidecar("change_log", "audit/change_log.json"),
)


def load_sidecar(spark: SparkSession, folder: str, s: Sidecar, load: str | None = None) -> dict[str, DataFrame]:
    """Its tables by name: one, or of nested documents <name>_headers, <name>_lines and <name>_references. Empty if the file is absent. A load id, if given, becomes upload_batch_id."""
    path = f"{folder.rstrip('/')}/{s.path}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return {}
    df = spark.read.option("multiLine", _is_array(spark, path)).json(path)
    out = dict(zip((f"{s.name}_headers", f"{s.name}_lines", f"{s.name}_references"), flow_tables(df), strict=True)) if s.nested else {s.name: df}
    return {k: v if load is None else v.withColumn("upload_batch_id", F.lit(load)) for k, v in out.items()}


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether the file is one JSON array (read whole) rather than a document to a line (read by splits)."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(first) and (first[0][0].lstrip().startswith("[") or first[0][0].strip() == "{")


def load_all(spark: SparkSession, folder: str, load: str | None = None) -> dict[str, DataFrame]:
    """Every sidecar's tables that are there."""
    return {k: v for s in SIDECARS for k, v in load_sidecar(spark, folder, s, load).items()}


def chart_of_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(account, name, category) of a chart in delimited text; the first column is the account, the next two may be absent. Repeated accounts count once."""
    t = read_text(spark, path).drop("_corrupt_record")
    c = [F.col(f"`{x}`") for x in t.columns]
    get = lambda k: F.nullif(F.trim(c[k]), F.lit("")) if k < len(c) else F.lit(None).cast("string")
    x = t.select(get(0).alias("account"), get(1).alias("name"), get(2).alias("category")).filter("account is not null")
    return x.groupBy("account").agg(F.min("name").alias("name"), F.min("category").alias("category"))


def labelled(df: DataFrame, labels: DataFrame, key: str = "document_id") -> DataFrame:
    """df with the labels of its documents (one row per document; of several labels the first in order, and how many)."""
    rest = [c for c in labels.columns if c != key]
    one = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_l"), F.count(F.lit(1)).alias("n_labels")).select(key, "_l.*", "n_labels")
    return df.join(one, key, "left")


def split_labels(df: DataFrame, labels: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(body, labels): the table without its label columns, and these alone, once per combination with the key."""
    return df.drop(*labels), df.select(key, *labels).dropDuplicates()


def reconciled(stated: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, stated, observed, state): what a load says of itself against what is there: same, differs, unstated, absent."""
    j = stated.select(key, F.col(value).alias("stated")).join(observed.select(key, F.col(value).alias("observed")), key, "full")
    return j.withColumn("state", F.when(F.col("observed").isNull(), "absent").when(F.col("stated").isNull(), "unstated").when(F.col("stated") == F.col("observed"), "same").otherwise("differs"))
