"""Passages looked for in texts: pieces of fixed length are found by rolling hashes, before anything is joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import written

#: Pieces held by a worker at once; more are looked for in further passes.
HELD = 1 << 21
#: Places of a text hashed at once.
SLICE = 1 << 20
_R = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of each stretch of `size` bytes: stretches of doubled length are put together from their halves."""
    out, done, own, n = np.zeros(max(0, len(data) - size + 1), np.uint64), 0, data.astype(np.uint64) + np.uint64(1), 1
    while n <= size:
        if size & n:  # the stretches of n bytes behind those taken so far
            out = out * np.uint64(pow(_R, n, _WORD + 1)) + own[done : done + len(out)]
            done += n
        if 2 * n <= size:
            own = own[:-n] * np.uint64(pow(_R, n, _WORD + 1)) + own[n:]
        n *= 2
    return _mixed(out).view(np.int64)


def _hashes_at(column: pa.Array, size: int, step: int) -> Iterator[np.ndarray]:
    """For each row the hashes of its stretches that start at multiples of step."""
    for value in column:
        data = np.frombuffer(value.as_buffer() or b"", np.uint8) if value.is_valid else np.zeros(0, np.uint8)
        yield rolled(data, size)[::step]


def pieces(passages: DataFrame, key: str, text: str, size: int = 24) -> DataFrame:
    """key, piece, times: the hashes of a passage's whole pieces, and how often each stands in it."""
    kind = passages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_hashes_at(b.column("bytes"), size, size))
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["key", "piece"])

    rows = passages.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("bytes")).mapInArrow(run, f"key {kind}, piece long")
    return rows.groupBy(F.col("key").alias(key), "piece").agg(F.count("*").alias("times"))


def hits(texts: DataFrame, key: str, text: str, wanted: DataFrame, size: int = 24) -> DataFrame:
    """key, piece: which of the pieces wanted (piece) stand anywhere in each text. Texts are read where they are; only hits leave."""
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    wanted = written(wanted.select("piece").distinct(), "pieces")
    passes = max(1, -(-wanted.count() // HELD))
    rows, out = texts.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("bytes")), None
    for k in range(passes):
        held = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.filter(F.pmod("piece", F.lit(passes)) == k).collect()], np.int64)))  # HELD numbers or so

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sought, mask = held.value, (1 << 20) - 1
            seen = np.zeros(mask + 1, bool)
            seen[sought & mask] = True
            for b in batches:
                at, found = [], []
                for i, value in enumerate(b.column("bytes")):
                    data = np.frombuffer(value.as_buffer() or b"", np.uint8) if value.is_valid else np.zeros(0, np.uint8)
                    own = []
                    for start in range(0, max(0, len(data) - size + 1), SLICE):
                        h = rolled(data[start : start + SLICE + size - 1], size)
                        h = h[seen[h & mask]]
                        own.append(np.unique(h[sought[np.minimum(np.searchsorted(sought, h), len(sought) - 1)] == h] if len(sought) else h[:0]))
                    own = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
                    found.append(own)
                    at.append(np.full(len(own), i))
                places = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(places)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["key", "piece"])

        found = rows.mapInArrow(run, f"key {kind}, piece long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key)


def likely(texts: DataFrame, passages: DataFrame, text_key: str, passage_key: str, share: float = 0.6, size: int = 24) -> DataFrame:
    """text_key, passage_key of pairs where the text has the share of the passage's whole pieces. texts and passages: key, t."""
    parts = written(pieces(passages, passage_key, "t", size), "parts")
    whole = parts.groupBy(passage_key).agg(F.sum("times").alias("whole"))
    found = hits(texts, text_key, "t", parts, size).join(parts, "piece").groupBy(text_key, passage_key).agg(F.sum("times").alias("n"))
    return found.join(whole, passage_key).filter(F.col("n") >= share * F.col("whole") - 1e-9).select(text_key, passage_key)
