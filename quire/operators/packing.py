"""Greedy packing of rows in order into batches of bounded size, without bringing a group to one task.

Rows are dealt by ranges of group and order. What a stretch of a group does to the batch that reaches it depends on that
batch's size alone: it goes on until the first row that no longer fits, and from there on the stretch's batches are its own.
So a stretch tells, for each row that may be the first not to fit, how many batches begin from there on and how full the last
one is at its end. A fold over the stretches (one row for each range) then gives every stretch the batch it begins in, and
the stretches are packed by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.sources.tables import written


def following(size: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first of the next batch, if a batch begins at it; len(size) where the stretch ends before."""
    upto = np.concatenate([[0], np.cumsum(size)])
    full = np.searchsorted(upto[1:], upto[:-1] + limit, side="right")  # the first row with which it is too much
    begun = np.searchsorted(upto, upto[:-1], side="right")  # an empty batch takes a row of any size
    return np.maximum(full, begun)


def effects(size: np.ndarray, limit: int) -> dict:
    """What a stretch does to a batch that reaches it.

    at: sums of sizes up to and with each row that may be the first not to fit; batches, last: how many batches begin from there
    on, and the last one's size at the end. total: the stretch's size. empty_batches, empty_last: the same for a batch of size 0.
    """
    n, next_ = len(size), following(size, limit)
    upto = np.concatenate([[0], np.cumsum(size)])
    batches, last = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = int(next_[i])
        batches[i], last[i] = (1 + batches[j], last[j]) if j < n else (1, int(upto[n] - upto[i]))
    head = np.flatnonzero((upto[:-1] <= limit) & ((size > 0) | (np.arange(n) == 0)))
    begun = int(np.searchsorted(upto, 0, side="right")) if n else 0  # rows before this leave an empty batch empty
    cut = max(int(np.searchsorted(upto[1:], limit, side="right")), begun)
    empty = (batches[cut], last[cut]) if cut < n else (0, int(upto[n]))
    return {"at": upto[1:][head].tolist(), "batches": [batches[i] for i in head], "last": [last[i] for i in head], "total": int(upto[n]), "empty_batches": empty[0], "empty_last": empty[1]}


def after(stretch: dict, used: int, limit: int) -> tuple[int, int]:
    """How many batches begin in a stretch that a batch of size `used` reaches, and the last one's size at its end."""
    if used == 0:
        return stretch["empty_batches"], stretch["empty_last"]
    k = 0 if used > limit else int(np.searchsorted(np.asarray(stretch["at"]), limit - used, side="right"))
    if k >= len(stretch["at"]):
        return 0, used + stretch["total"]
    return stretch["batches"][k], stretch["last"][k]


EFFECTS = "at array<long>, batches array<long>, last array<long>, total long, empty_batches long, empty_last long"
_ARROW = [("at", pa.list_(pa.int64())), ("batches", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("total", pa.int64()), ("empty_batches", pa.int64()), ("empty_last", pa.int64())]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, parts) for each run of rows of equal keys; rows come sorted."""
    at, parts = None, []
    for b in batches:
        columns = [b.column(k).to_pylist() for k in keys]
        found = list(zip(*columns, strict=True))
        cuts = [0, *[i for i in range(1, len(found)) if found[i] != found[i - 1]], len(found)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if parts and found[i] != at:
                yield at, parts
                parts = []
            at = found[i]
            parts.append(b.slice(i, j - i))
    if parts:
        yield at, parts


def packed(rows: DataFrame, by: list[str], order: str, size: str, limit: int) -> DataFrame:
    """by, order, batch (from 0 in each group): consecutive rows until the next would make a batch larger than limit; a larger row is alone.

    rows should be narrow. A null size counts as 0; null keys are a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [f"_{i}" for i in range(len(by))]
    narrow = rows.select(*[F.col(c).alias(p) for c, p in zip(by, place, strict=True)], F.col(order).alias("_order"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    dealt = written(narrow.repartitionByRange(n, *place, "_order").withColumn("_range", F.spark_partition_id()), "ranges")
    sort = ["_range", *place, "_order"]
    key = StructType([dealt.schema["_range"], *[dealt.schema[p] for p in place]])

    # groups that are in several ranges, and what each of their stretches does
    long = dealt
    if place:
        spans = written(dealt.groupBy("_range", *place).count().groupBy(*place).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "spans")
        long = dealt.alias("d").join(spans.alias("s"), [F.col(f"d.{p}").eqNullSafe(F.col(f"s.{p}")) for p in place], "left_semi")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, parts in _groups(batches, ["_range", *place]):
            told = effects(np.concatenate([np.asarray(p.column("_size")) for p in parts]), limit)
            keys = [parts[0].column(c).slice(0, 1) for c in ("_range", *place)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([told[c]], t) for c, t in _ARROW)], names=["_range", *place, *(c for c, _ in _ARROW)])

    told = written(long.repartition("_range").sortWithinPartitions(*sort).mapInArrow(tell, f"{_ddl(key)}, {EFFECTS}"), "effects")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, batch = None, 0, 0
        for b in batches:
            starts, sizes = [], []
            for row in b.to_pylist():
                group = tuple(row[p] for p in place)
                if group != at:
                    at, used, batch = group, 0, 0
                starts.append(batch)
                sizes.append(used)
                more, used = after(row, used, limit)
                batch += more
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_range", *place)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["_range", *place, "_batch", "_used"])

    by_group = told.repartition(*place) if place else told.coalesce(1)
    begins = written(by_group.sortWithinPartitions(*place, "_range").mapInArrow(begin, f"{_ddl(key)}, _batch long, _used long"), "begins")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, batch, used = None, 0, 0
        for b in batches:
            out = []
            of = list(zip(*[b.column(c).to_pylist() for c in ("_range", *place)], strict=True))
            for at, size, first, reached in zip(of, b.column("_size").to_pylist(), b.column("_batch").to_pylist(), b.column("_used").to_pylist(), strict=True):
                if at != group:
                    group, batch, used = at, first or 0, reached or 0
                if used and used + size > limit:
                    batch, used = batch + 1, 0
                used += size
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*place, "_order")), pa.array(out, pa.int32())], names=[*place, "_order", "batch"])

    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_range", *place)]
    joined = dealt.alias("d").join(begins.alias("b"), same, "left").select("d.*", "_batch", "_used")
    schema = StructType([*[dealt.schema[p] for p in place], dealt.schema["_order"], StructField("batch", IntegerType())])
    found = joined.repartition("_range").sortWithinPartitions(*sort).mapInArrow(pack, schema)
    return found.select(*[F.col(p).alias(c) for p, c in zip(place, by, strict=True)], F.col("_order").alias(order), "batch")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
