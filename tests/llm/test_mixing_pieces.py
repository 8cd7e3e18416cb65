import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, mixing, pieces

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3)]


@pytest.fixture(scope="module")
def tokens(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choices("abcx", [6, 3, 1, 1])[0], rnd.randint(0, 900)) for k in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_shares_and_caps(spark, tokens):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    got = mixing.mix(tokens, t).collect()
    plan = {r["source"]: r for r in mixing.plan(tokens, t)}
    total = sum(r["n_tokens"] for r in got)
    assert plan["a"]["budget"] - 900 <= total <= plan["a"]["budget"]
    for s, share, cap in TARGETS[:3]:
        of = [r for r in got if r["source"] == s]
        assert abs(sum(r["n_tokens"] for r in of) / total - share) < 0.02  # 'none' has no documents, the shares of the others add up to 1
        assert max(r["copy_no"] for r in of) <= cap
        assert len({(r["doc_id"], r["copy_no"]) for r in of}) == len(of)
    assert [r["finish_time"] for r in got] == sorted(r["finish_time"] for r in got)
    rep = {r["source"]: r for r in mixing.shares(mixing.mix(tokens, t), t).collect()}
    assert rep["none"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9


def test_equals_brute_force(spark, tokens, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BIN", 50)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    budget = 120_000
    got = {(r["doc_id"], r["copy_no"]) for r in mixing.mix(tokens, t, budget).collect()}
    plan = {r["source"]: r for r in mixing.plan(tokens, t, budget) if r["weight"] > 0}
    queue = []
    h = {(r["doc_id"], r["c"]): r["h"] for r in tokens.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("c")).withColumn("h", F.xxhash64("doc_id", "c", F.lit(0))).collect()}
    n = sum(p["docs"] for p in plan.values())
    bins = max(16, -(-n // 50))
    for s, p in plan.items():
        docs = [r for r in tokens.collect() if r["source"] == s and r["n_tokens"] > 0]
        cum = 0
        for c in range(1, int(p["max_repeats"]) + 1):
            for r in sorted(docs, key=lambda r: (((h[r["doc_id"], c] % 2**64) >> 20) % bins, h[r["doc_id"], c], r["doc_id"])):  # noqa: B023
                cum += r["n_tokens"]
                queue.append((cum / p["weight"], s, r["doc_id"], c, r["n_tokens"]))
    used, want = 0, set()
    for _, _, d, c, k in sorted(queue):
        if used + k > budget:
            break
        used += k
        want.add((d, c))
    assert got == want


def test_mix_of_nothing(spark, tokens):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.mix(tokens.limit(0), t).count() == 0 and mixing.mix(tokens, t.limit(0)).count() == 0


def check_pieces(text, limit, overlap):
    e = bpe.encoder()
    got = pieces.split_text(e, text, limit, overlap)
    if e.count(text) <= limit:
        assert got == []
        return got
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for lo, hi, n in got:
        assert lo < hi and e.count(text[lo:hi]) == n <= limit
    for (lo, hi, _), (lo2, hi2, _) in zip(got, got[1:]):
        assert lo < lo2 <= hi < hi2 and overlap - overlap // 8 - 4 <= e.count(text[lo2:hi]) <= overlap
    return got


def test_pieces_of_documents(spark, small):
    n = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        if r["text"]:
            n += len(check_pieces(r["text"], 64, 8)) + len(check_pieces(r["text"], 512, 64))
    assert n > 500


def test_pieces_of_odd_texts():
    rnd = random.Random(6)
    for alphabet in ("가나다", "ab  \n\n", "!'s ", "😀👩‍💼é", "\n\n\n  x", "0123,.", "ab.\n\n# H\n", "'", "'s", "'d' ", "x'll", "\u2028\r\f\v\x85a", "\x1c\xa0\u3000z", "。가!", "܀𒀀ࠀ"):
        for size in (10, 300, 3000):
            check_pieces("".join(rnd.choices(alphabet, k=size)), 32, 6)
            check_pieces("".join(rnd.choices(alphabet, k=size)), 9, 4)


def test_no_text_is_dropped():
    for text in ("'" * 20_000, "word " * 400 + "'" * 9000 + " word" * 400, "'s" * 5000, " " * 60_000, "\n" * 60_000, "ab" * 20_000 + " " + "7" * 9000, "\U00012345" * 4000, "https://x.y/" + "a1-" * 9000):
        assert check_pieces(text, 512, 64)


def test_cuts_between_characters_where_the_tokenizer_has_none(monkeypatch):
    import numpy as np

    none = np.empty(0, np.int64)
    monkeypatch.setattr(pieces.Grid, "within", lambda self, k: (none, none))
    for text in ("x1" * 3000, "word " * 400 + "'s" * 900 + " word" * 400, "가나다라" * 900):
        e = bpe.encoder()
        got = pieces.split_text(e, text, 64, 8)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(e.count(text[lo:hi]) == n <= 64 for lo, hi, n in got)
        assert all(lo < lo2 <= hi < hi2 for (lo, hi, _), (lo2, hi2, _) in zip(got, got[1:]))


def test_sentences_and_breaks_without_blanks():
    text = "감사인이확인하였다.장부는늦게마감되었다." * 60
    assert all(text[hi - 1] == "." for _, hi, _ in check_pieces(text, 100, 10)[:-1])
    for mark in ("\r\r", "\u2029", "\f", "\r\n\r\n"):
        text = mark.join(["one two three four five six seven"] * 60)
        assert all(text[hi:].lstrip()[:3] == "one" for _, hi, _ in check_pieces(text, 60, 5)[:-1])
    check_pieces("x" * 50_000, 128, 0)
    assert check_pieces(None or "", 32, 4) == []


def test_natural_boundaries_are_preferred():
    para = "The clerk posted the entry. It was late, and nobody saw it. "
    text = "\n\n".join((para * 3).strip() for _ in range(20))
    got = check_pieces(text, 120, 10)
    assert all(text[hi : hi + 2] == "\n\n" or text[hi - 1 : hi + 1] == "\n\n" for _, hi, _ in got[:-1])
    got = check_pieces(para * 40, 50, 0)
    assert all((para * 40)[:hi].rstrip().endswith(".") for _, hi, _ in got)


def test_strongest_is_rightmost():
    import numpy as np

    rnd = random.Random(7)
    s = np.array([rnd.randint(0, 4) for _ in range(200)])
    best = pieces.Strongest(s)
    for _ in range(500):
        lo = rnd.randrange(200)
        hi = rnd.randint(lo + 1, 200)
        assert best.of(lo, hi) == max(range(lo, hi), key=lambda i: (s[i], i))


def test_split_frame(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "word " * 2000, "p"), (3, "word " * 2000, "p"), (4, "short", "p")], "doc_id long, text string, piece string")
    got = pieces.split_oversized(df, "doc_id", "text", 256, 32).collect()
    assert {r["doc_id"] for r in got} == {3} and len(got) % 2 == 0 and all(r["piece"] == ("word " * 2000)[r["start_char"] : r["end_char"]] for r in got)
    with pytest.raises(ValueError):
        pieces.split_oversized(df, "doc_id", "text", 64, 32)
