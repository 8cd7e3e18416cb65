"""The N best items of every group.

Each task keeps, per group, a heap of at most N items and passes on only those (built before the shuffle); the heaps of a
group are merged afterwards by a pass over rows sorted by group, which holds one heap at a time. So a group of any size
costs N rows per task, and no group is gathered.

Defined results: an item that occurs several times in a group counts once, with its highest score; equal scores are ordered by the
item's identifier, ascending; rows with a null group or item or a null or NaN score take no part; groups with fewer
than N items give what they have; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items that a task holds before it passes its heaps on and starts anew; bounds memory where a task meets millions of groups.
HELD = 300_000


class _Worse:
    """Orders identifiers downwards, so that a heap's root is the item to give up first."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other):
        return self.id > other.id

    def __eq__(self, other):
        return self.id == other.id


class Best:
    """A heap of the n best of what was added. root: the worst of those kept."""

    __slots__ = ("heap", "n", "score")

    def __init__(self, n: int):
        self.heap: list[tuple] = []
        self.n, self.score = n, {}

    def add(self, score: float, id_) -> None:
        heap = self.heap
        if id_ in self.score:
            if score > self.score[id_]:
                self.score[id_] = score
                for k, (_, w) in enumerate(heap):
                    if w.id == id_:
                        heap[k] = (score, w)
                        break
                heapq.heapify(heap)
        elif len(heap) < self.n:
            self.score[id_] = score
            heapq.heappush(heap, (score, _Worse(id_)))
        elif score > heap[0][0] or (score == heap[0][0] and id_ < heap[0][1].id):
            _, gone = heapq.heapreplace(heap, (score, _Worse(id_)))
            del self.score[gone.id]
            self.score[id_] = score

    def ranked(self) -> list[tuple]:
        return sorted(((i, s) for i, s in self.score.items()), key=lambda x: (-x[1], x[0]))


def top_n_per_group(df: DataFrame, group_col: str, score_col: str, id_col: str, n: int, rank_name: str = "rank_no") -> DataFrame:
    """(group_col, id_col, score_col, rank_no int). The score keeps its type, so whole numbers and decimals are compared as they are."""
    f = {x.name: x for x in df.schema.fields}
    base = [T.StructField(group_col, f[group_col].dataType), T.StructField(id_col, f[id_col].dataType), T.StructField(score_col, f[score_col].dataType)]
    partial, final = T.StructType(base), T.StructType([*base, T.StructField(rank_name, T.IntegerType())])

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in b.columns), strict=True)

    def batch(groups: list, ids: list, scores: list, like: pa.Schema, ranks: list | None = None) -> pa.RecordBatch:
        cols = [pa.array(groups, like.field(0).type), pa.array(ids, like.field(1).type), pa.array(scores, like.field(2).type)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(ranks, pa.int32())] if ranks is not None else cols, names=[group_col, id_col, score_col, rank_name][: 3 + (ranks is not None)])

    def out(best: dict, like: pa.Schema) -> pa.RecordBatch:
        flat = [(g, i, s) for g, h in best.items() for i, s in h.score.items()]
        return batch([x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat], like)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, like = {}, None
        for b in batches:
            like = b.schema
            for g, i, s in rows(b):
                h = best.get(g)
                if h is None:
                    h = best[g] = Best(n)
                # most rows of a large group fall here
                if len(h.heap) < n or s >= h.heap[0][0]:
                    h.add(s, i)
            if len(best) * n > HELD:
                yield out(best, like)
                best = {}
        if best:
            yield out(best, like)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, h, like = None, None, None
        done: tuple[list, list, list, list] = ([], [], [], [])

        def close() -> None:
            for k, (i, s) in enumerate(h.ranked()):
                for to, x in zip(done, (group, i, s, k + 1), strict=True):
                    to.append(x)

        for b in batches:
            like = b.schema
            for g, i, s in rows(b):
                if h is None or g != group:
                    if h is not None:
                        close()
                    group, h = g, Best(n)
                h.add(s, i)
            if len(done[0]) >= 50_000:
                yield batch(*done[:3], like, done[3])
                done = ([], [], [], [])
        if h is not None:
            close()
            yield batch(*done[:3], like, done[3])

    clean = df.select(group_col, id_col, score_col).filter(F.col(group_col).isNotNull() & F.col(id_col).isNotNull() & F.col(score_col).isNotNull())
    if isinstance(f[score_col].dataType, (T.DoubleType, T.FloatType)):
        clean = clean.filter(~F.isnan(score_col))
    heaps = clean.mapInArrow(before, partial)
    return heaps.repartition(F.col(group_col)).sortWithinPartitions(group_col).mapInArrow(after, final)
