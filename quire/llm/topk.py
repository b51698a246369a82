"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's components are floor(scale * x). For a cut of the dimensions into segments, a vector is described
by each segment's mean and deviation; the distance of two vectors is at least that of their descriptions,

    |q - x|^2  >=  sum over segments of  L ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and with the known norms a least distance is a greatest inner product. Cuts of 1, 4 and 16 segments are
tried coarse to fine; what may still reach a query's k-th best score is then scored exactly.

Candidates are dealt into lanes of bounded size. A lane's task holds its candidates and their descriptions, and the
queries stream past in batches; a query's best k of the lane leave at once, and a window per query picks the best of
all lanes. A candidate moves once, a query once for each lane.

Defined results
---------------
* Vectors that are null, or hold a null or non-finite component, take no part; neither do rows without an id. All others
  do, whatever their size. A score is exact; one that would be among the best and is no long raises an error.
* Every row is a vector of its own, and a query if its id says so: rows that repeat an id find each other. Ties go to the
  smaller id.
* A query is compared with vectors of its own length only.
* A query with fewer candidates than k returns them all; an empty table returns nothing.
* Only vec_id and embedding are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import settle, tune

SEGMENTS = (1, 4, 16)
#: Bytes of vectors in a lane, as 8 bytes a component; descriptions add less than as much.
LANE = 32 << 20
#: Pairs of query and candidate bounded at once, and scored one by one at once.
BOUNDED, PAIRS = 1 << 19, 1 << 15
#: Products of norms below these make scores that doubles, and that 64-bit integers, find exactly; others are found with Python's integers.
EXACT, SAFE = 2.0**53, 2.0**62
#: Share of a block's pairs from which on survivors are scored as a whole block.
MANY = 0.02
#: A bound's share of the product of norms that rounding may cost it; scores are whole numbers, so 1 is added besides.
ROUNDING = 1e-9


def describe(v: np.ndarray, segments: int) -> np.ndarray:
    """Rows: each segment's mean and deviation, times the root of its length, so that a dot product bounds the inner product."""
    cuts = np.linspace(0, v.shape[1], segments + 1).astype(int)
    size = np.diff(cuts).astype(float)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / size
    square = np.add.reduceat(v * v, cuts[:-1], axis=1) / size
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0) * size)])


class Vectors:
    """Rows of whole numbers (as doubles) with what bounds and scores need of them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        if not np.isfinite(v).all():
            raise OverflowError("a scaled component is no number")
        self.rows, self.ids, self.v = rows, ids, v
        self.whole = np.clip(v, -SAFE, SAFE).astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt((v * v).sum(axis=1))
            slack = self.norm[:, None] * np.sqrt(ROUNDING)
            self.told = [np.hstack([describe(v, s), slack]) for s in SEGMENTS if s <= v.shape[1]]

    def part(self, start: int, end: int) -> Vectors:
        """The rows from start to end, with what is known of them."""
        out = object.__new__(Vectors)
        out.rows, out.ids, out.v, out.whole, out.norm = (x[start:end] for x in (self.rows, self.ids, self.v, self.whole, self.norm))
        out.told = [x[start:end] for x in self.told]
        return out


def scores(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """The inner products of a's rows i with b's rows j."""
    if not len(i):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        if a.norm.max() * b.norm.max() < EXACT:
            return np.concatenate([np.einsum("ij,ij->i", a.v[i[k : k + PAIRS]], b.v[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]).astype(np.int64)
        wide = np.flatnonzero(~(a.norm[i] * b.norm[j] < SAFE))
    out = np.concatenate([np.einsum("ij,ij->i", a.whole[i[k : k + PAIRS]], b.whole[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)])
    for k in wide:
        exact = sum(int(x) * int(y) for x, y in zip(a.v[i[k]].tolist(), b.v[j[k]].tolist(), strict=True))
        if not -(1 << 63) <= exact < 1 << 63:
            raise OverflowError(f"the score of {a.ids[i[k]]} and {b.ids[j[k]]} is no long")
        out[k] = exact
    return out


def survivors(asked: Vectors, some: Vectors, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in asked, places in some) that may reach a query's k-th best score by every cut, coarse to fine."""
    columns = np.arange(len(some.ids))
    alive = asked.rows[:, None] != some.rows[None, :]
    for mine, theirs in zip(asked.told, some.told, strict=True):
        with np.errstate(invalid="ignore", over="ignore"):  # what can't be bounded stays
            alive &= ~(mine @ theirs[columns].T + 1 < kth[:, None])
        left = alive.any(axis=0)
        if not left.all():
            columns, alive = columns[left], alive[:, left]
    a, b = np.nonzero(alive)
    return a, columns[b]


def best(asked: Vectors, lane: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in asked, and ids and scores of their k best in lane; a row is not its own candidate."""
    q, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = np.full(len(asked.ids), -np.inf)
    start, step, most = 0, 4 * k, max(1, BOUNDED // max(1, len(kth)))  # a few first, then more and more: bounds have better scores to beat
    while start < len(lane.ids):
        end = min(start + step, len(lane.ids))
        some = lane.part(start, end)
        a, b = survivors(asked, some, kth)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = len(a) > MANY * len(kth) * (end - start) and asked.norm.max() * some.norm.max() < EXACT
        found = (asked.v @ some.v.T)[a, b].astype(np.int64) if whole else scores(asked, a, some, b)
        stay = found >= kth[a]
        q, ids, score = np.concatenate([q, a[stay]]), np.concatenate([ids, some.ids[b[stay]]]), np.concatenate([score, found[stay]])
        order = np.lexsort((ids, ~score, q))  # ~ turns the order of longs round without overflow
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kth[q[rank == k - 1]] = score[rank == k - 1]
        q, ids, score = (c[rank < k] for c in (q, ids, score))
        start, step = end, min(2 * step, most)
    return q, ids, score


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that is_query selects."""
    spark = vectors.sparkSession
    tune(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    # floor() of a double is a long in Spark; a whole number beyond is its own floor
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**50, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v")).withColumn("dims", F.size("v")), "vectors")
    held = rows.agg(F.sum(8 * F.col("dims"))).first()[0] or 0
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // LANE))
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")
    offered = rows.select("row", "vec_id", "v", "dims", lane.alias("lane"), F.lit(0).alias("role"))
    asked = rows.filter(is_query).select("row", "vec_id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("role"))
    key = ["dims", "lane"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []  # of the lane that is coming in
        held: Vectors | None = None
        at = None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c), np.int64) for c in (*key, "role")], axis=1)
            rows, ids, flat, size = np.asarray(b.column("row")), np.asarray(b.column("vec_id")), np.asarray(b.column("v").flatten(), float), keys[:, 0]
            place = np.concatenate([[0], np.cumsum(size)])
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                if tuple(keys[i, :2]) != at:
                    at, parts, held = tuple(keys[i, :2]), [], None
                some = rows[i:j], ids[i:j], flat[place[i] : place[j]].reshape(j - i, int(size[i]))
                if keys[i, 2] == 0:
                    parts.append(some)
                elif parts or held:
                    if held is None:
                        held, parts = Vectors(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                    asked = Vectors(*some)
                    q, found, score = best(asked, held, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (asked.rows[q], asked.ids[q], found, score)], names=["row", "query_id", "vec_id", "score"])

    # the work is in the pairs and not in the bytes, so lanes are spread over more partitions than there are, and not put together again
    dealt = offered.unionByName(asked).repartition(4 * lanes, *key).sortWithinPartitions(*key, "role")
    local = dealt.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
