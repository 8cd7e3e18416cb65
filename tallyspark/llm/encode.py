"""Encoding a corpus with a public tokenizer.

Defined results: a null and an empty text have no ids (an empty list); the strings of special tokens are ordinary text; very long texts
and texts without breaks are encoded whole, in linear time; repeated rows come out as often as they occur."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder

#: About so many bytes of ids leave a worker at a time.
OUT_BYTES = 4 << 20


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, ids): the ids of each text."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)

        def out(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[id_col, "ids"])

        for b in batches:
            first, size, ids = 0, 0, []
            for k in range(b.num_rows):
                ids.append(enc.encode_bytes(b.column(1)[k].as_py()))
                size += len(ids[-1])
                if size >= OUT_BYTES:
                    yield out(b.column(0).slice(first, k + 1 - first), ids)
                    first, size, ids = k + 1, 0, []
            if ids:
                yield out(b.column(0).slice(first), ids)

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns `keep` and n_tokens (bigint; 0 for a null or empty text)."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = b.column(len(keep))
            n = pa.array([enc.count(texts[k].as_py()) for k in range(b.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, text): the texts that ids stand for; no ids give an empty text."""
    schema = T.StructType([df.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema)
