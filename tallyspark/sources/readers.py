"""Readers by format. Detection looks at the first 64 kB of a file, whatever its size, on the driver; reading is distributed."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import marks, read_repaired

TEXT, SHEETS = {"csv", "tsv", "txt", "dat"}, {"xlsx", "xls", "xlsb"}
#: Largest accepted file per class, in bytes (spreadsheets are read on the driver).
LIMITS = {"text": None, "sheet": 200 << 20, "parquet": None, "json": None}
SAMPLE = 64 << 10


class BadFile(ValueError):
    pass


def classify(path: str) -> str:
    ext = path.rstrip("/").rpartition(".")[2].lower()
    if ext in TEXT:
        return "text"
    if ext in SHEETS:
        return "sheet"
    if ext in ("parquet", "json", "jsonl"):
        return "json" if ext != "parquet" else "parquet"
    raise BadFile(f"unknown extension: {ext}")


@dataclass(frozen=True)
class Found:
    kind: str
    size: int
    head: bytes


def inspect(spark: SparkSession, path: str) -> Found:
    """Existence, size and the first bytes, through the file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise BadFile(f"no such file: {path}")
    kind, size = classify(path), fs.getContentSummary(p).getLength()
    if size == 0:
        raise BadFile("empty file")
    if LIMITS[kind] and size > LIMITS[kind]:
        raise BadFile("too large for its kind")
    head = b""
    if fs.getFileStatus(p).isFile():
        stream = fs.open(p)
        try:
            head = bytes(stream.readNBytes(SAMPLE))
        finally:
            stream.close()
    if kind == "parquet" and head and head[:4] != b"PAR1":
        raise BadFile("not a parquet file")
    if kind == "text" and b"\0" in head[:4096] and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        raise BadFile("binary content")
    return Found(kind, size, head)


def detect_encoding(head: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 by its mark, else the first of the usual legacy code pages that decodes."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    cut = head[:-4] if len(head) > 8 else head  # the sample may end within a character
    for enc in ("utf-8", "cp949"):
        for end in range(len(cut), max(0, len(cut) - 4), -1):
            try:
                cut[:end].decode(enc)
                return "UTF-8" if enc == "utf-8" else "MS949"
            except UnicodeDecodeError:
                continue
    return "ISO-8859-1"


def detect_separator(text: str) -> str:
    """The separator that cuts most of the first lines into the same number of fields, more than one."""
    lines = [x for x in text.splitlines()[:50] if x.strip()]
    best = (0.0, 0, ",")
    for sep in (",", "\t", ";", "|"):
        widths = [len(r) for r in csv.reader(lines, delimiter=sep)]
        if not widths:
            continue
        mode = max(set(widths), key=widths.count)
        if mode > 1:
            best = max(best, (widths.count(mode) / len(widths), mode, sep))
    return best[2]


def detect_header(rows: list[list[str]], known: set[str] | None = None) -> tuple[int, float]:
    """(index, confidence) of the row that looks most like a header: text rather than numbers, no blanks, no repetitions, known names."""
    known = known or set()

    def score(r: list[str]) -> float:
        cells = [c.strip() for c in r]
        full = [c for c in cells if c]
        if not full:
            return 0.0
        words = sum(not c.replace(".", "").replace("-", "").replace(",", "").isdigit() for c in full) / len(full)
        return 0.3 * words + 0.2 * len(full) / len(cells) + 0.2 * len(set(full)) / len(full) + 0.3 * (sum(c.lower() in known for c in full) / len(full) if known else words)

    scores = [score(r) for r in rows] or [0.0]
    at = max(range(len(scores)), key=lambda k: (scores[k], -k))
    return at, scores[at]


def widest(text: str, separator: str, lines: int = 50) -> int:
    """The largest number of fields of the first lines: titles above a table are narrower than it."""
    return max((len(r) for r in csv.reader([x for x in text.splitlines()[:lines] if x.strip()], delimiter=separator)), default=0)


def read_text(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None) -> DataFrame:
    """Delimited text, all columns as strings, with lines that don't fit kept in _corrupt_record. Read by splits unless a line has an odd number of quotation marks, which
    shows that records span lines (or quotes are broken); such a file is put together by sources.text."""
    head = inspect(spark, path).head
    encoding = encoding or detect_encoding(head)
    if encoding.upper() not in ("UTF-8", "UTF-16", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # other code pages are refused otherwise
    text = head.decode({"MS949": "cp949"}.get(encoding, encoding), errors="replace").lstrip("﻿")
    separator = separator or detect_separator(text)
    names = [c.strip() or f"column_{k + 1}" for k, c in enumerate(next(csv.reader(text.splitlines(), delimiter=separator)))]
    names += [f"column_{k + 1}" for k in range(len(names), widest(text, separator))]
    names = [c if c not in names[:k] else f"{c}_{k + 1}" for k, c in enumerate(names)]
    utf16 = encoding.upper().startswith("UTF-16")
    if not utf16 and not spark.read.option("encoding", encoding).text(path).filter(marks(F.col("value")) % 2 == 1).isEmpty():
        x = read_repaired(spark, path, names, separator, encoding)
        return x.withColumn("_corrupt_record", F.to_json("_more")).drop("_more")
    schema = ", ".join(f"`{c}` string" for c in names) + ", `_corrupt_record` string"
    return spark.read.schema(schema).csv(path, header=True, sep=separator, encoding=encoding, quote='"', escape='"', multiLine=utf16, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=True)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheets have no distributed source; LIMITS bounds what the driver reads. Needs a reader for the format."""
    import pandas as pd

    inspect(spark, path)
    local = path.removeprefix("file://")
    try:
        return spark.createDataFrame(pd.read_excel(local, dtype=str).ffill())
    except ImportError as e:
        raise BadFile(f"no reader for this format is installed: {e}") from e


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = inspect(spark, path).kind
    if kind == "text":
        return read_text(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.json(path, **({"multiLine": True} | options)) if kind == "json" else read_sheet(spark, path)


def flow_tables(nested: DataFrame, header: str = "header", lines: str = "items", refs: str = "references") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested documents as (headers, lines, references); lines and references carry the document's id. Parts that are missing give empty tables with the id alone."""
    doc = F.col(f"{header}.document_id").alias("document_id")
    part = lambda c: nested.select(doc, F.explode(c).alias("x")).select("document_id", *([F.col(f"x.{f}").alias(f if f != "document_id" else "ref_document_id") for f in nested.schema[c].dataType.elementType.names])) if c in nested.columns else nested.select(doc).limit(0)
    return nested.select(f"{header}.*"), part(lines), part(refs)
