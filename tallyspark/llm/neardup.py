"""Near-duplicate records by an LSH forest with exact verification.

A record has a text (as a set of character shingles), an amount, a day and a group; two records are alike if the groups are equal, the days
and amounts are near and the Jaccard similarity of the texts reaches a threshold.

Records that are equal in all respects are one class and take part once. Each tree of the forest is a sorted prefix trie over the
classes. The first labels of a path are those on which all trees agree: the group, a cell of days and a cell of amounts (a record near
a cell's edge stands in both cells, so no near pair is cut). The labels after them are minima of min-wise hash functions, other ones in
each tree; there is at least one. Two records are candidates where their paths share a prefix. The prefix is shortened per cell: it is as
long as the cell's population pays for, and there are as many trees as it takes to bring (1 - t^k) to the power of their number, the
chance to miss a pair at the very threshold t, within the target. So the target recall holds in cells of every size; no cell, bucket or
partner list is capped.

Only keys, numbers of classes, and days and amounts packed into one number go through the shuffle; a bucket is joined by
sort-merge, with nearness in the condition. Each pair of classes is then looked at once: an upper bound of the similarity from bit sets
(exact: a bit that only one side has proves a shingle that only one side has) drops most, and the texts of the others are fetched and
their shingle sets compared, many pairs at a time.

Defined results: texts are lower-cased, trimmed, runs of white space become one space; texts shorter than the shingle never pair;
records with a null group, day or amount never pair; an empty table gives no pairs; very long texts take part whole; records that
repeat an id are one record if they are equal and pair like any others if not, save with themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_or_shuffled, written

#: Words of the bit set of a text's shingles, 64 bits each.
WORDS = 4
KEY = ["grp", "day", "amount", "text"]


@dataclass(frozen=True)
class Alike:
    days: int = 7
    amount: float = 0.02
    similarity: float = 0.5
    shingle: int = 3
    recall: float = 0.9999  # of pairs at the very threshold; of pairs above it more
    full: int = 2000  # records of a cell beyond which one label more costs less (in trees) than it saves (in candidates)
    widen: int = 4  # by how much the population must grow for the next
    day_cell: int = 28
    amount_cell: float = 0.1  # of the natural logarithm

    def trees(self, depth: int) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity**depth))

    def depth(self, records: int) -> int:
        """Labels after the cell's."""
        return 1 + sum(records > n for n in self.sizes())

    def sizes(self) -> list[int]:
        """Populations beyond which a path has one label more."""
        return [n for d in range(40) if (n := self.full * self.widen**d) < 2**62]


def tidy(text: str) -> str:
    return " ".join(text.lower().split())


def shingle_codes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): the distinct shingles of each text, as 64-bit numbers (exact up to 3 characters, hashed beyond), sorted by owner."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            code = (code << np.uint64(21) if k <= 3 else code * np.uint64(0x9E3779B97F4A7C15)) + points[j : j + n]
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    left = np.repeat(np.cumsum(size), size)[:n] - np.arange(n)
    inside = left >= k
    code, owner = code[inside], owner[inside]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])] if len(code) else np.empty(0, bool)
    return code[new], owner[new]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function of each number."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sketched(df: DataFrame, a: Alike) -> DataFrame:
    """df with columns (id, grp, day, amount, text) -> the same with the text tidied, its number of shingles and their bit set."""
    schema = T.StructType([*(df.schema[c] for c in ("id", "grp", "day", "amount")), T.StructField("text", T.StringType()), T.StructField("shingles", T.IntegerType()), *(T.StructField(f"b{j}", T.LongType()) for j in range(WORDS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [tidy(x or "") for x in b.column(4).to_pylist()]
            code, owner = shingle_codes(texts, a.shingle)
            size = np.bincount(owner, minlength=len(texts))
            bits = np.zeros((len(texts), WORDS), np.uint64)
            at = mixed(code, 1) % np.uint64(64 * WORDS)
            np.bitwise_or.at(bits, (owner, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string()), pa.array(size.astype(np.int32)), *(pa.array(bits[:, j].view(np.int64)) for j in range(WORDS))], names=schema.names)

    return df.select("id", "grp", "day", "amount", "text").mapInArrow(run, schema)


def classes(records: DataFrame, a: Alike) -> tuple[DataFrame, DataFrame]:
    """(records, classes), both written: the sketched records, and one row per set of equal ones, with a number cid, its least id and how many records it has."""
    s = written(sketched(records.filter("id is not null"), a), "records")
    made = [F.max(c).alias(c) for c in ("shingles", *(f"b{j}" for j in range(WORDS)))]
    c = s.groupBy(*KEY).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *made)
    return s, written(c.withColumn("cid", F.monotonically_increasing_id()), "classes")


def in_cells(df: DataFrame, a: Alike) -> DataFrame:
    """A row for each cell that a record stands in: its own, and the one before if the record is near enough to its lower edge."""
    near = -math.log1p(-a.amount) * (1 + 1e-9)
    log = F.log("amount")
    days = F.array_distinct(F.array(F.floor(F.col("day") / a.day_cell), F.floor((F.col("day") - a.days) / a.day_cell)))
    amounts = F.array_distinct(F.array(F.floor(log / a.amount_cell), F.floor((log - near) / a.amount_cell)))
    return df.withColumn("_d", F.explode(days)).withColumn("_m", F.explode(amounts)).withColumn("cell", F.xxhash64("grp", "_d", "_m")).drop("_d", "_m")


def paths(rows: DataFrame, a: Alike) -> DataFrame:
    """(cid, asked, cell, depth, at, text) -> (key, cid, asked, at): a row for each tree, keyed by the path's prefix of that depth."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("asked", T.BooleanType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                cid, cell, depth = b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()
                new = np.r_[True, cid[1:] != cid[:-1]]  # the cells of a class follow one another; its labels are made once
                of = np.cumsum(new) - 1
                code, owner = shingle_codes(b.column(5).filter(pa.array(new)).to_pylist(), a.shingle)
                first = np.searchsorted(owner, np.arange(of[-1] + 1))
                for d in np.unique(depth):
                    take = np.flatnonzero(depth == d)
                    got = b.take(pa.array(take))
                    for tree in range(a.trees(int(d))):
                        key = mixed(cell[take], 7 + tree)
                        for level in range(int(d)):
                            low = np.minimum.reduceat(mixed(code, 1000 + tree * 64 + level), first)
                            key = mixed(key ^ low[of[take]], 3 + level)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), got.column(0), got.column(1), got.column(4)], names=schema.names)

    return rows.select("cid", "asked", "cell", "depth", "at", "text").mapInArrow(run, schema)


def exact(candidates: DataFrame, a: Alike) -> DataFrame:
    """Candidates (id_a, id_b, ta, tb) whose texts reach the similarity, by comparing the shingle sets, many pairs at a time."""
    schema = T.StructType([candidates.schema["id_a"], candidates.schema["id_b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                n = b.num_rows
                (ca, oa), (cb, ob) = (shingle_codes(b.column(k).to_pylist(), a.shingle) for k in (2, 3))
                code, owner = np.concatenate([ca, cb]), np.concatenate([oa, ob])
                order = np.lexsort((code, owner))
                code, owner = code[order], owner[order]
                twice = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
                common = np.bincount(owner[1:][twice], minlength=n)
                either = np.bincount(owner, minlength=n) - common
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=schema.names).filter(pa.array(common >= a.similarity * either))

    return candidates.select("id_a", "id_b", "ta", "tb").mapInArrow(run, schema)


def _may(a: Alike) -> Column:
    """Whether sides x and y are near and can reach the similarity: shingles in both are at most those of either side less the ones proven to be on one side only."""
    col = lambda side, c: F.col(f"{side}.{c}")
    only = lambda p, q: sum((F.bit_count(col(p, f"b{j}").bitwiseAND(F.bitwise_not(col(q, f"b{j}")))) for j in range(WORDS)), F.lit(0))
    both = F.least(col("x", "shingles") - only("x", "y"), col("y", "shingles") - only("y", "x"))
    may = both * (1 + a.similarity) >= a.similarity * (col("x", "shingles") + col("y", "shingles"))
    near = (F.abs(col("x", "day") - col("y", "day")) <= a.days) & (F.abs(col("x", "amount") - col("y", "amount")) <= a.amount * F.greatest(col("x", "amount"), col("y", "amount")))
    return near & may & (col("x", "grp") == col("y", "grp"))


def _able() -> Column:
    return F.col("grp").isNotNull() & F.col("day").isNotNull() & (F.col("amount") > 0) & (F.col("amount") < float("inf")) & (F.col("shingles") > 0)


def _verified(candidates: DataFrame, c: DataFrame, a: Alike) -> DataFrame:
    """Of pairs (id_a, id_b) of classes those that are alike."""
    sketch = c.select("cid", "grp", "day", "amount", "shingles", *(f"b{j}" for j in range(WORDS)))
    x, y = sketch.alias("x"), sketch.alias("y")
    left = small_or_shuffled(candidates.join(x, F.col("id_a") == F.col("x.cid")).join(y, F.col("id_b") == F.col("y.cid")).filter(_may(a)).select("id_a", "id_b"))
    t = c.select("cid", "text")
    return exact(t.select(F.col("cid").alias("id_a"), F.col("text").alias("ta")).join(left, "id_a").join(t.select(F.col("cid").alias("id_b"), F.col("text").alias("tb")), "id_b"), a)


def links(c: DataFrame, a: Alike, asked: Column | None = None) -> DataFrame:
    """(id_a, id_b), pairs of alike classes, each once with id_a < id_b; with `asked`, a condition on classes, the pairs that have such a class as id_a, in either order."""
    able = c.filter(_able()).withColumn("asked", F.lit(True) if asked is None else F.coalesce(asked, F.lit(False)))
    # day and amount in one number; the amount's logarithm in millionths
    able = able.withColumn("at", F.shiftleft(F.col("day").cast("bigint"), 32) + F.floor(F.log("amount") * 1e6) + 1_000_000_000)
    x = in_cells(able, a)
    depth = reduce(lambda d, n: d + (F.col("n") > n).cast("int"), a.sizes(), F.lit(1))
    shared = x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("any")).filter("n > 1 and any").select("cell", depth.alias("depth"))
    keyed = paths(x.select("cid", "asked", "cell", "at", "text").join(small_or_shuffled(shared), "cell"), a)
    x, y = keyed.alias("x"), keyed.alias("y")
    day, amount = (lambda s: F.shiftright(F.col(f"{s}.at"), 32)), (lambda s: F.col(f"{s}.at").bitwiseAND(F.lit(0xFFFFFFFF)))
    near = (F.abs(day("x") - day("y")) <= a.days) & (F.abs(amount("x") - amount("y")) <= math.ceil(-math.log1p(-a.amount) * 1e6) + 1)
    other = F.col("x.cid") < F.col("y.cid") if asked is None else F.col("x.asked") & (F.col("x.cid") != F.col("y.cid"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & other & near).select(F.col("x.cid").alias("id_a"), F.col("y.cid").alias("id_b"))
    return _verified(met.distinct(), c, a)


def _same(x: str, y: str) -> Column:
    return reduce(lambda p, q: p & q, (F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in KEY))


def alike_pairs(records: DataFrame, a: Alike = Alike()) -> DataFrame:  # noqa: B008
    """records (id, grp, day int, amount double, text) -> (id_a, id_b), id_a < id_b, one row per pair of alike records: those of linked classes, and those within one."""
    s, c = classes(records, a)
    found = written(links(c, a), "links")
    several = c.filter(F.col("n") > 1).filter(_able())
    inner = s.alias("s").join(small_or_shuffled(several.select("cid", *KEY)).alias("q"), _same("s", "q")).select("cid", F.col("s.id").alias("id"))
    member = c.filter(F.col("n") == 1).select("cid", "id").unionByName(inner)
    m = lambda side: member.select(F.col("cid").alias(f"id_{side}"), F.col("id").alias(side))
    over = found.join(m("a"), "id_a").join(m("b"), "id_b").select("a", "b")
    within = inner.select("cid", F.col("id").alias("a")).join(inner.select("cid", F.col("id").alias("b")), "cid").select("a", "b").filter("a < b")
    return over.filter("a <> b").unionByName(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def ledger_documents(gl: DataFrame) -> DataFrame:
    """One record per document and company: day of posting, greatest local amount, and the text compared."""
    day = F.datediff(F.col("posting_date").cast("date"), F.lit("1970-01-01").cast("date"))
    text = F.concat(F.coalesce("header_text", F.lit("")), F.lit(" "), F.coalesce("reference", F.lit("")))
    amount = F.when(~F.isnan("local_amount"), F.col("local_amount"))
    return gl.groupBy(F.col("document_id").alias("id"), F.col("company_code").alias("grp")).agg(F.min(day).alias("day"), F.max(amount).alias("amount"), F.max(text).alias("text")).filter(F.col("id").isNotNull())


def links_per_record(records: DataFrame, a: Alike = Alike()) -> DataFrame:  # noqa: B008
    """(id, class_id, n_links), one row per record: its class of equal records, named by the least id, and to how many other classes that is alike. Equal are records with the same group, day, amount
    and tidied text, nulls being equal to nulls."""
    s, c = classes(records, a)
    n = links(c, a).select(F.explode(F.array("id_a", "id_b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    of = c.join(n, "cid", "left").select(*KEY, F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n")
    plain = of.filter("n = 1").select(F.col("class_id").alias("id"), "class_id", "n_links")
    several = s.alias("s").join(small_or_shuffled(of.filter("n > 1")).alias("q"), _same("s", "q")).select(F.col("s.id").alias("id"), "class_id", "n_links")
    return plain.unionByName(several)


def recall(records: DataFrame, asked: Column, a: Alike = Alike()) -> DataFrame:  # noqa: B008
    """One row: of the classes that meet `asked` (a condition on id), how many links there are by comparing each with every other of its group, and how many the forest finds."""
    _, c = classes(records, a)
    got = written(links(c, a, asked), "found")
    able = c.filter(_able()).select("cid", "id", *KEY, "shingles", *(f"b{j}" for j in range(WORDS)))
    few = small_or_shuffled(able.filter(asked))
    # the stated query set against all rows, group by group
    may = few.alias("x").join(able.alias("y"), _may(a) & (F.col("x.cid") != F.col("y.cid")))
    all_ = written(exact(may.select(F.col("x.cid").alias("id_a"), F.col("y.cid").alias("id_b"), F.col("x.text").alias("ta"), F.col("y.text").alias("tb")), a), "all")
    hit = all_.join(got.withColumn("hit", F.lit(1)), ["id_a", "id_b"], "left")
    return hit.agg(F.count(F.lit(1)).alias("links"), F.count("hit").alias("found"))
