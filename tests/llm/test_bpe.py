import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import bpe, encode


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def by_merging(enc, piece):
    """The merges run one after another, as they are defined."""
    ids = [next(i for k, (n, i) in [(0, enc.auto.get(c))]) for c in piece.encode().decode("latin-1")]
    whole = {enc.left[t] << 20 | enc.right[t]: t for t in range(len(enc.rank)) if enc.rank[t] >= 0}
    while True:
        best = min(((enc.merged[a << 20 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in enc.merged), default=None)
        if best is None:
            return ids
        k = best[1]
        ids[k : k + 2] = [whole[ids[k] << 20 | ids[k + 1]]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab's  \n\t　\xa0\x1c\x85 1२가나éß😀👩!'re<|endoftext|>", max_size=40))
def test_equals_library(s):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        _T.encode_special_tokens = True
    assert bpe.encoder().encode(s) == _T.encode(s, add_special_tokens=False).ids


def test_equals_merges(enc):
    rnd = random.Random(5)
    for _ in range(150):
        p = "".join(rnd.choice("abcdeotinr0123가는") for _ in range(rnd.randint(1, 14)))
        assert enc.piece(p) == by_merging(enc, p)


def test_small_caches_change_nothing(enc, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    e = bpe.Encoder(bpe.default_path(), bpe.default_pattern())
    s = "Accrual of packaging film 123456 for retail desk, 2023-08 판매 장려금 정산 " * 5
    assert e.encode(s) == library(s) and e.count(s) == len(library(s))


def test_corpus(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode_corpus(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == (library(r["text"]) if r["text"] else [])


def test_null_empty_long(spark, library):
    long = "가나다라마바사" * 20_000
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, long, "c"), (3, "x", "c")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in encode.encode_corpus(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted([(1, []), (2, []), (3, library(long)), (3, library("x"))])
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
