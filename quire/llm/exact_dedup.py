"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are read as 16-bit symbols and hashed as a polynomial modulo two primes. The
hash of a concatenation is the sum of its parts' hashes, each shifted by the symbols that follow it
(times base ** symbols), so a huge document's chunks are hashed in parallel tasks and added up by an
ordinary aggregate. Texts of equal length and fingerprint are then compared chunk by chunk, streaming
over sorted chunk rows, with that of their group's representative; a text that differs (a collision)
goes into a further round among its like.

Defined results
---------------
* A null text counts as empty; all empty texts are equal.
* Every row counts and gives a row. Rows repeating doc_id and text are compared once; if theirs is the document that stays
  they are all marked so, and kept_rows() keeps one of them. Rows that share a doc_id but differ in text are different documents.
* A null doc_id is less than any other. An empty table gives an empty result.
* Only the columns doc_id and text are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, settle, tune

PRIMES = (2147483647, 2147483629)
BASES = (1000003129, 784562387)
#: 64 KiB is 2**15 symbols below 2**16, times residues below 2**31: a chunk's dot product stays under 2**62.
CHUNK = 1 << 16
#: Texts beyond this many bytes are hashed chunk by chunk in separate tasks.
HUGE = 1 << 20
#: Documents that are compared with one copy of their group's representative.
SALTED = 32

KEY = ["n_bytes", "fp1", "fp2"]
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Descending powers of each base, the last being 1."""
    if not _powers:
        for p, b in zip(PRIMES, BASES, strict=True):
            up = np.ones(CHUNK // 2, np.int64)
            n = 1
            while n < len(up):  # doubling: the next n powers are the first n times base ** n
                up[n : 2 * n] = up[:n] * pow(b, n, p) % p
                n *= 2
            _powers.append(up[::-1].copy())
    return _powers


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    symbols = np.frombuffer(chunk + b"\0" * (len(chunk) % 2), "<u2").astype(np.int64)
    n = len(symbols)
    return tuple(int(np.dot(symbols, w[len(w) - n :]) % p) if n else 0 for w, p in zip(powers(), PRIMES, strict=True))


def shifted(hashes: tuple[int, int], symbols_after: int) -> tuple[int, int]:
    return tuple(h * pow(b, symbols_after, p) % p for h, b, p in zip(hashes, BASES, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """The hash of a whole text, as the sum of its chunks' shifted hashes."""
    if len(data) <= CHUNK:
        return chunk_hash(data)
    total = [0, 0]
    for start in range(0, len(data), CHUNK):
        part = shifted(chunk_hash(data[start : start + CHUNK]), (len(data) + 1) // 2 - (min(start + CHUNK, len(data)) + 1) // 2)
        total = [(t + x) % p for t, x, p in zip(total, part, PRIMES, strict=True)]
    return tuple(total)


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_buffer().to_pybytes()) for x in batch.column("bytes")]
        columns = [batch.column(c) for c in ("doc_id", "uid", "text_sha256", "n_bytes")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["doc_id", "uid", "text_sha256", "n_bytes", "fp1", "fp2"])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shifted(chunk_hash(x.as_buffer().to_pybytes()), after) for x, after in zip(batch.column("chunk"), batch.column("after").to_pylist(), strict=True)]
        columns = [batch.column(c) for c in ("row", "doc_id", "uid", "text_sha256", "n_bytes")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["row", "doc_id", "uid", "text_sha256", "n_bytes", "h1", "h2"])


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """doc_id, uid, text_sha256, n_bytes, fp1, fp2: a row for each row of docs."""
    tune(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("uid"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("bytes")
    )
    same = f"doc_id {ids}, uid long, text_sha256 string, n_bytes long"
    small = texts.filter(F.col("n_bytes") <= huge).mapInArrow(_hash_texts, f"{same}, fp1 long, fp2 long")
    pieces = (
        texts.filter(F.col("n_bytes") > huge)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "uid", "text_sha256", "n_bytes", F.posexplode(F.expr(f"transform(sequence(0L, (n_bytes - 1) div {CHUNK}), i -> substring(bytes, cast(i * {CHUNK} + 1 as int), {CHUNK}))")).alias("k", "chunk"))
        .withColumn("after", F.expr(f"(n_bytes + 1) div 2 - (least(n_bytes, (k + 1L) * {CHUNK}) + 1) div 2"))
        .repartition("uid", "k")
    )
    summed = pieces.mapInArrow(_hash_chunks, f"row long, {same}, h1 long, h2 long").groupBy("row", "doc_id", "uid", "text_sha256", "n_bytes").agg((F.sum("h1") % PRIMES[0]).alias("fp1"), (F.sum("h2") % PRIMES[1]).alias("fp2"))
    return small.unionByName(summed.drop("row"))


def _assign(rows: DataFrame) -> DataFrame:
    """rows with keep_id, keep_uid (of the largest document of equal length and fingerprint), group_size (rows) and members (documents).

    Both sides of the join come from plain exchanges, so that adaptive execution may split a hot group.
    """
    groups = rows.groupBy(*KEY).agg(F.sum("copies").alias("group_size"), F.count("*").alias("members"), F.max(F.struct("doc_id", "uid")).alias("keep")).filter("members > 1")
    groups = settle(groups.select(*KEY, "group_size", "members", F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid")), "groups")
    found = rows.join(groups, KEY, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        *rows.columns,
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.col("uid")).otherwise(F.col("keep_uid")).alias("keep_uid"),
        F.coalesce("group_size", "copies").cast("long").alias("group_size"),
        F.coalesce("members", F.lit(1)).cast("long").alias("members"),
    )


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group, salt and chunk, the representative's chunk first; holds one chunk at a time. Chunks of one text may be in different tasks."""
    at, ref = None, b""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (*KEY, "salt", "k")), strict=True))
        member, chunks, differ = batch.column("member").to_pylist(), batch.column("chunk"), []
        for i, key in enumerate(keys):
            if not member[i]:
                at, ref = key, chunks[i].as_buffer().to_pybytes()
            elif key != at or chunks[i].as_buffer().to_pybytes() != ref:
                differ.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(differ, pa.int64())) for c in ("doc_id", "uid")], names=["doc_id", "uid"])


def _verify(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, uid of the documents whose text is not that of their representative."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    salts = F.ceil(F.col("members") / SALTED).cast("int")
    is_keep = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("uid") == F.col("keep_uid"))
    wanted = assigned.filter("members > 1").select(
        "doc_id", "uid", *KEY, (~is_keep).alias("member"),
        F.explode(F.when(is_keep, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), salts).cast("int")))).alias("salt"),
    )
    texts = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("text")).withColumn("u", F.xxhash64("text"))
    chunks = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("u") == F.col("uid"))).select(
        *KEY, "salt", "member", "doc_id", "uid",
        F.posexplode(F.expr(f"transform(sequence(0L, greatest(n_bytes - 1, 0L) div {CHUNK}), i -> substring(cast(text as binary), cast(i * {CHUNK} + 1 as int), {CHUNK}))")).alias("k", "chunk"),
    )
    place = [*KEY, "salt", "k"]
    return chunks.repartition(*place).sortWithinPartitions(*place, "member").mapInArrow(_differing, f"doc_id {ids}, uid long").distinct()


def duplicates(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, uid, text_sha256, n_bytes, fp1, fp2, copies (rows repeating it), keep_id, keep_uid, group_size, members."""
    rows = fingerprints(docs, huge)
    rows = settle(rows.groupBy("doc_id", "uid", *KEY, "text_sha256").agg(F.count("*").alias("copies")), "fingerprints")
    done: DataFrame | None = None
    while True:
        assigned = settle(_assign(rows), "assigned")
        differ = settle(_verify(assigned, docs), "differing")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "uid")]
        ended = not differ.take(1)
        if not ended:  # fingerprints collided: those that differ are grouped anew among themselves
            rest = settle(assigned.alias("a").join(differ.alias("b"), same, "left_semi").select(*rows.columns), "collided")
            assigned = settle(_assign(settle(assigned.alias("a").join(differ.alias("b"), same, "left_anti").select(*rows.columns), "agreed")), "assigned")
            rows = rest
        done = assigned if done is None else done.unionByName(assigned)
        if ended:
            forget(differ)
            return done


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of equal texts the document with the largest id, once."""
    found = duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("uid") == F.col("keep_uid")))
    keep = found.select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), F.col("copies").alias("n"))
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid"), F.struct(*docs.columns).alias("row"))
    rows = whole.join(keep, F.col("id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")))
    once = rows.filter("n > 1").groupBy("d", "u").agg(F.first("row").alias("row"))
    return rows.filter("n = 1").select("row.*").unionByName(once.select("row.*"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, a row for each row: doc_id, keep_id, group_size, kept, text_sha256."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("uid") == F.col("keep_uid"))
    many = 1_000_000  # rows made from one at once
    rows = duplicates(docs).withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / many))))
    rows = rows.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(many).cast("long"), F.col("copies") - F.col("_turn") * many))))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
