"""Byte-level BPE in linear time, for use inside Python workers.

The merges of a vocabulary file are reproduced exactly, without running them: bytes are mapped to Latin-1 characters, an
Aho-Corasick automaton gives the tokens that match at each place, and a backtracking pass takes the longest token
that fits its left neighbour. Whether two tokens may stand side by side (whether the merges would ever join them
across the seam) depends on the two alone and is memoised. A place from which no continuation exists is remembered, so
every place is left at most once.

Text is first cut where a space is followed by something that isn't white space. The pre-tokenising pattern always
has a boundary there, so the parts are encoded independently and their ids are kept in a cache of bounded size.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import regex

#: Entries of each cache; a full cache is emptied.
CACHE = 400_000
#: Longer parts are not kept.
KEEP = 64
_SEAM = re.compile(r" (?=\S)").split
#: Text of these characters alone is cut by a narrower pattern, which gives the same pieces and is quicker.
_PLAIN = re.compile(r"[ -~\n\uac00-\ud7a3]*").fullmatch
_PLAIN_FIND = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\uac00-\ud7a3]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+").findall
_loaded: dict[tuple[str, str], "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(path: str | None = None, pattern: str | None = None) -> "Encoder":
    """The encoder of a vocabulary file, once per process."""
    path, pattern = path or default_path(), pattern or default_pattern()
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(path, pattern)
    return _loaded[path, pattern]


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files write each byte as one printable character: printable bytes as themselves, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Cache(dict):
    """Values made on demand; emptied when full. Long keys are not kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEEP:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids are handled as bytes, four to an id, so that the ids of a text are one join of cached parts."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = _byte_of_char()
        latin = {t: "".join(chr(chars[c]) for c in t) for t in model["vocab"] if all(c in chars for c in t)}
        ids = {latin[t]: i for t, i in model["vocab"].items() if t in latin}
        size = max(ids.values()) + 1
        self.length, self.rank, self.left, self.right, self.shorter = ([0] * size, [-1] * size, [-1] * size, [-1] * size, [-1] * size)
        self.merged: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib, t = ids[latin[a]], ids[latin[b]], ids[latin[a] + latin[b]]
            self.merged[ia << 20 | ib] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, ia, ib
        self.auto = ahocorasick.Automaton()
        self.raw = [b""] * size
        for word, i in ids.items():
            self.raw[i] = word.encode("latin-1")
            # a longer token that no merge makes can't come out of the merges
            if len(word) == 1 or self.rank[i] >= 0:
                self.length[i] = len(word)
                self.auto.add_word(word, (len(word) - 1, i))
        self.auto.make_automaton()
        for word, i in ids.items():
            for k in range(len(word) - 1, 0, -1):
                if (j := ids.get(word[:k])) is not None and self.length[j]:
                    self.shorter[i] = j
                    break
        self.find = regex.compile(pattern).findall
        self.plain = pattern == default_pattern()
        self.seams: dict[int, bool] = {}
        self.parts = _Cache(lambda s: self.run(" " + s))  # by part, without the space before it
        self.words = _Cache(self.run)  # by part, with the white space before it
        self.pieces = _Cache(lambda s: array("i", self.piece(s)).tobytes())

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side."""
        return (a << 20 | b) not in self.merged and self.apart(a, b)

    def apart(self, a: int, b: int) -> bool:
        """The same, given that a and b themselves are not joined. The one made by the later merge is taken apart; its neighbouring half
        and the other must not have been joined before that merge, and so on backwards. Equal merges run from the
        left, so one on the right side comes after one across the seam. What follows depends on the two halves alone, so it
        is remembered, for all pairs of tokens that end and begin alike."""
        ra, rb = self.rank[a], self.rank[b]
        if ra > rb:
            before, a = ra, self.right[a]
        elif rb >= 0:
            before, b = rb + 1, self.left[b]
        else:
            return True
        key = a << 20 | b
        if self.merged.get(key, before) < before:
            return False
        ok = self.seams.get(key)
        if ok is None:
            if len(self.seams) >= CACHE:
                self.seams.clear()
            ok = self.seams[key] = self.apart(a, b)
        return ok

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the pre-tokenising pattern."""
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        longest = [0] * n
        for end, (k, t) in self.auto.iter(raw):  # of the matches from one place, the longest comes last
            longest[end - k] = t
        length, shorter, merged, apart = self.length, self.shorter, self.merged, self.apart
        t = longest[0]
        if length[t] == n:
            return [t]
        out, at, prev, dead = [], 0, -1, None
        while True:
            end = at + length[t]
            ok = dead is None or end not in dead
            if ok and prev >= 0:
                key = prev << 20 | t
                ok = key not in merged and apart(prev, t)
            if ok:
                out.append(t)
                if end == n:
                    return out
                at, prev, t = end, t, longest[end]
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                dead = dead or set()
                dead.add(at)
                t = out.pop()
                at -= length[t]
                prev = out[-1] if out else -1

    def split(self, text: str) -> list[str]:
        """The pieces of the pre-tokenising pattern."""
        return (_PLAIN_FIND if self.plain and _PLAIN(text) else self.find)(text)

    def run(self, text: str) -> bytes:
        """Ids of a text of any kind."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each; a null or empty text has none."""
        if not text:
            return b""
        first, *rest = _SEAM(text)
        return self.run(first) + b"".join(map(self.parts.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids that encode() gave; bytes of ids that end within a character become the usual replacement."""
        return b"".join(map(self.raw.__getitem__, ids or [])).decode("utf-8", "replace")

    def count(self, text: str | None) -> int:
        """The number of ids."""
        return len(self.encode_bytes(text)) // 4
