"""Splitting oversized texts at natural boundaries.

Places where a text may be cut are found with their strength (section over paragraph over sentence over line over word) and their
distance from the start in tokens. All are places at which the tokenizer has a boundary either way, so the tokens of a piece are
exactly those between its two ends, and no piece is encoded again. A sparse table over the strengths gives the strongest cut of any
window in constant time: the window is what the limit permits, ties go to the right, and the next piece begins
`overlap` tokens before the cut.

Where a window holds no such place, the text is cut between tokens of a long word, and where the tokenizer permits none of these
either, between any two characters, the tokens of such a piece being counted anew. The next piece begins at the first place of the
grid within the overlap; if that would leave out more than an eighth of the overlap, it begins within a word.

Defined results: texts within the limit, null and empty ones give no pieces; every text over the limit gives pieces that are all within
it, cover the text without gaps, in order, and are substrings of it, whatever characters it is made of; text without any break is cut
between tokens, never within a character; repeated rows are cut each. Two neighbours share at most `overlap` tokens and
at least seven eighths of it, less the tokens of one character (four at most).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, encoder

SECTION, PARAGRAPH, SENTENCE, LINE, WORD = 5, 4, 3, 2, 1
#: Cuts a text before the last white space in front of a word: the tokenizer always begins a piece there.
_SEAM = re.compile("(?=[ \n\t\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]\\S)").split
_BREAK = re.compile("\r\n|[\n\r\v\x85\u2028]").findall
_PAGE = re.compile("[\f\u2029]").search
_END = frozenset(".!?…。！？")
_CLOSE = frozenset("\"')]}”’」』")
_HEADING = re.compile(r"(?:#{1,6} |§|\[?[A-Z]{1,3}-?\d+(?:[.-]\d+)*\]?[ .:]|\d+(?:\.\d+)*[.)] |제 ?\d+ ?[장조절]|(?:Section|Chapter|SECTION) )").match
#: The end of a sentence that the next one follows without white space, as is usual where scripts need none.
_RUN_ON = re.compile("[.!?…。！？][.!?…。！？\"')\\]}”’」』]*(?=[^\\W_])").finditer
#: Marks that end a sentence whatever stands before them; the others do after a letter of such scripts.
_FULL, _UNSPACED = frozenset("。！？…"), re.compile("[\uac00-\ud7a3\u3040-\u30ff\u4e00-\u9fff]").match
#: What the tokenizer takes as one piece wherever a text begins with it.
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)").match



def _among(chars) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


_IS_END, _IS_CLOSE, _IS_SPACE = _among(_END), _among(_CLOSE), _among(" \n\t\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _strength(before: str, after: str) -> int:
    body = before.rstrip()
    space = before[len(body) :] + after[0]
    breaks = len(_BREAK(space))
    page = _PAGE(space) is not None
    if (breaks or page) and _HEADING(after, 1):
        return SECTION
    if breaks > 1 or page:
        return PARAGRAPH
    if body and (body[-1] in _END or (body[-1] in _CLOSE and body[-2:-1] in _END)):
        return SENTENCE
    return LINE if breaks else WORD


def _points(chars: list[str]) -> np.ndarray:
    return np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32)


class Strongest:
    """A sparse table of maxima: the index of the strongest entry of a range, the rightmost if several are."""

    def __init__(self, strength: np.ndarray):
        n = len(strength)
        self.rows = [strength.astype(np.int64) << 32 | np.arange(n)]
        k = 1
        while 2 * k <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-k], last[k:]))
            k *= 2

    def of(self, lo: int, hi: int) -> int:
        """In lo..hi - 1."""
        k = (hi - lo).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k)])) & 0xFFFFFFFF


class Grid:
    """The places where a text may be cut, as (token offset, character offset). Those between words and sentences are made for the whole
    text; those within a word when they are asked for. total: the tokens of the text, all that is made for a text within the limit."""

    def __init__(self, enc: Encoder, text: str, limit: int):
        parts = _SEAM(text)
        if not parts[0]:
            parts = parts[1:]
        self.enc, self.text, self.parts, self.found = enc, text, parts, {}
        n = len(parts)
        tokens = np.fromiter(map(len, map(enc.words.__getitem__, parts)), np.int64, n) // 4
        self.total = int(tokens.sum())
        if self.total <= limit:
            return
        size = np.fromiter(map(len, parts), np.int64, n)
        self.part_tok, self.part_char = np.cumsum(tokens) - tokens, np.cumsum(size) - size
        tok, chars = self.part_tok[1:], self.part_char[1:]
        strength = np.full(n - 1, WORD, np.int64)
        last = _points([p[-1] for p in parts[:-1]])
        plain = (_points([p[0] for p in parts[1:]]) == 32) & ~_IS_SPACE[last]  # one space between words
        strength[plain & _IS_END[last]] = SENTENCE
        close = np.flatnonzero(plain & _IS_CLOSE[last])
        strength[close[_IS_END[_points([parts[k][-2:-1] or " " for k in close])]]] = SENTENCE
        for k in np.flatnonzero(~plain):
            strength[k] = _strength(parts[k], parts[k + 1])
        ends = [] if text.isascii() else [m.end() for m in _RUN_ON(text) if text[m.start()] in _FULL or (m.start() and _UNSPACED(text, m.start() - 1))]
        if ends:
            more = []
            for k in np.unique(np.searchsorted(self.part_char, ends, "right") - 1):
                t, c = self.within(int(k))
                more.append(np.stack([t, c])[:, np.isin(c, ends)])
            t, c = np.concatenate(more, axis=1)
            tok, chars, strength = np.concatenate([tok, t]), np.concatenate([chars, c]), np.concatenate([strength, np.full(len(t), SENTENCE)])
            order = np.argsort(chars, kind="stable")
            tok, chars, strength = tok[order], chars[order], strength[order]
        self.tok, self.chars, self.best = tok, chars, Strongest(strength)

    def within(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places within a part: between pieces of the tokenizer's pattern, and between tokens of one piece at whole characters."""
        if k not in self.found:
            tok, chars = [], []
            text, t, c, before = self.parts[k], int(self.part_tok[k]), int(self.part_char[k]), " "
            at0, enc = c, self.enc
            for p in enc.split(text):
                ids = np.frombuffer(enc.pieces[p], np.int32)
                if not before[-1].isspace():
                    tok.append(t)
                    chars.append(c)
                if len(ids) > 1:
                    raw = np.frombuffer(p.encode("utf-8", "surrogatepass"), np.uint8)
                    starts = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
                    at = 0
                    for j, i in enumerate(ids[:-1].tolist()):
                        at += enc.length[i]
                        if raw[at] & 0xC0 != 0x80:
                            char = int(starts[at]) - 1
                            # after the space that leads a piece there is no cut: it would join white space before it; nor where the rest would begin with a contraction
                            if (p.isspace() or not p[char - 1].isspace()) and not (p[char] == "'" and _CONTRACTION(text, c - at0 + char)):
                                tok.append(t + j + 1)
                                chars.append(c + char)
                t += len(ids)
                c += len(p)
                before = p
            self.found[k] = np.array(tok, np.int64), np.array(chars, np.int64)
        return self.found[k]

    def part_at(self, t: int) -> int:
        return int(np.searchsorted(self.part_tok, t, "right")) - 1

    def cut(self, start: int, ended: int, least: int, limit: int) -> tuple[int, int] | None:
        """The best place for a piece that begins at token `start` to end, after character `ended`, where the last one did; None if there is none within the limit."""
        first = int(np.searchsorted(self.chars, ended, "right"))
        hi = int(np.searchsorted(self.tok, start + limit, "right"))
        lo = max(first, int(np.searchsorted(self.tok, start + least, "left")))
        if lo < hi:
            k = self.best.of(lo, hi)
            return int(self.tok[k]), int(self.chars[k])
        # the window lies within one part
        t, c = self.within(self.part_at(start + limit))
        j = int(np.searchsorted(t, start + limit, "right")) - 1
        if j >= 0 and c[j] > ended:
            return int(t[j]), int(c[j])
        return (int(self.tok[hi - 1]), int(self.chars[hi - 1])) if hi > first else None

    def back(self, at: int, char: int, overlap: int, start: int, begin: int) -> tuple[int | None, int]:
        """Where the piece after a cut begins; after `begin`, where the last one did. No token offset if it isn't a place of the grid."""
        want = max(at - overlap, start + 1)
        j = max(int(np.searchsorted(self.tok, want, "left")), int(np.searchsorted(self.chars, begin, "right")))
        got = (int(self.tok[j]), int(self.chars[j])) if j < len(self.tok) and self.chars[j] < char else (at, char)
        if got[0] - want > overlap // 8:
            t, c = self.within(self.part_at(want))
            j = int(np.searchsorted(t, want, "left"))
            if j < len(t) and begin < c[j] < got[1]:
                got = int(t[j]), int(c[j])
        if got[0] - want > overlap // 8:
            to = _farthest(lambda a: self.count(a, char) <= overlap, char, begin + 1, overlap)
            if to < got[1]:
                return None, to
        return got

    def count(self, a: int, b: int) -> int:
        return len(self.enc.run(self.text[a:b])) // 4

    def ahead(self, char: int) -> tuple[int, int]:
        """The first white space to cut at after a character, or the end. There the tokenizer begins anew, wherever in front of it a piece may have begun."""
        j = int(np.searchsorted(self.part_char, char, "right"))
        return (int(self.part_tok[j]), int(self.part_char[j])) if j < len(self.part_char) else (self.total, len(self.text))


def _farthest(ok, near: int, far: int, step: int) -> int:
    """The farthest place on the way from near to far (either direction) up to which ok() was seen to hold; it holds at near."""
    way = 1 if far >= near else -1
    good, bad = near, None
    while bad is None and good != far:
        to = good + way * min(step, abs(far - good))
        if ok(to):
            good, step = to, step * 2
        else:
            bad = to
    while bad is not None and abs(bad - good) > 1:
        mid = (good + bad) // 2
        if ok(mid):
            good = mid
        else:
            bad = mid
    return good


def _anywhere(g: Grid, begin: int, end: int, limit: int, overlap: int, out: list[tuple[int, int, int]]) -> int:
    """Cuts the text from begin to end, where the tokenizer has no place to cut, between characters, until the rest is within the limit; gives the rest's begin."""
    while (to := _farthest(lambda b: g.count(begin, b) <= limit, min(end, begin + limit // 4), end, limit)) < end:  # noqa: B023
        out.append((begin, to, g.count(begin, to)))
        begin = _farthest(lambda a: g.count(a, to) <= overlap, to, begin + 1, max(1, overlap))  # noqa: B023
    return begin


def split_text(enc: Encoder, text: str | None, limit: int, overlap: int, least: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, in characters; nothing for a text within the limit. A piece that isn't the last has at least `least` tokens (half the limit) where there is a cut."""
    if not text or len(text) * 4 <= limit:
        return []
    g = Grid(enc, text, limit)
    if g.total <= limit:
        return []
    out, start, begin, ended = [], 0, 0, 0
    least = max(overlap + 1, limit // 2) if least is None else least
    while start is None or g.total - start > limit:
        cut = None if start is None else g.cut(start, ended, least, limit)
        if cut is None:  # from here to the next white space the grid does not hold
            t, end = g.ahead(ended - (start is None))
            begin = _anywhere(g, begin, end, limit, overlap, out)
            start, ended = t - g.count(begin, end), max(ended, end - 1)
            continue
        out.append((begin, cut[1], cut[0] - start))
        ended = cut[1]
        start, begin = g.back(*cut, overlap, start, begin)
    out.append((begin, len(text), g.total - start))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 64, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, piece_no, start_char, end_char, n_tokens, piece) of every text of more than `limit` tokens; limit of at least 8, overlap < limit / 2."""
    if limit < 8 or not 0 <= overlap < limit // 2:
        raise ValueError("limit must be at least 8 and overlap under half of it")
    names = [id_col, "piece_no", "start_char", "end_char", "n_tokens", "piece"]
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.IntegerType()) for c in names[1:5]), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            owner, rows, size = [], [], 0

            def out(key=b.column(0)):
                cols = [pa.array(c, pa.int32()) for c in zip(*(r[:4] for r in rows), strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([key.take(pa.array(owner)), *cols, pa.array([r[4] for r in rows], pa.string())], names=names)  # noqa: B023

            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                for j, (lo, hi, n) in enumerate(split_text(enc, text, limit, overlap)):
                    owner.append(k)
                    rows.append((j + 1, lo, hi, n, text[lo:hi]))
                    size += hi - lo
                if size > 2_000_000:
                    yield out()
                    owner, rows, size = [], [], 0
            if rows:
                yield out()

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def audit(docs: DataFrame, pieces: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """One row that counts what must not be: pieces over the limit, texts whose pieces leave a gap, don't begin at 0 or don't reach the end, pieces that differ from the text between their ends, neighbours without overlap though it is asked for.

    id_col must be unique. Windows run over the pieces of one document, which are as many as its length allows."""
    w = Window.partitionBy(id_col).orderBy("piece_no")
    p = pieces.join(docs.select(F.col(id_col), F.col(text_col).alias("_t")), id_col)
    p = p.select(id_col, "piece_no", "start_char", "end_char", "n_tokens", (F.col("piece") != F.substring("_t", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).alias("other"), F.length("_t").alias("len"))
    p = p.withColumns({"before": F.lag("end_char").over(w), "first": F.lag("start_char").over(w)})
    g = p.groupBy(id_col).agg(
        F.count_if(F.col("n_tokens") > limit).alias("over_limit"), F.count_if("other").alias("altered"), F.count_if(F.col("start_char") > F.coalesce("before", F.lit(0))).alias("gaps"), F.count_if(F.col("start_char") <= F.col("first")).alias("unordered"),
        F.count_if((F.col("start_char") == F.col("before")) if overlap else F.lit(False)).alias("unlapped"), (F.max("end_char") < F.max("len")).cast("long").alias("unfinished"),
    )
    names = ["over_limit", "altered", "gaps", "unordered", "unlapped", "unfinished"]
    return g.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
