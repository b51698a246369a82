"""What the operators of this subpackage share: tables in the shared folder, prefix sums, Arrow helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.tables import new_path, shared_folder, written

__all__ = ["new_path", "settle", "shared_folder"]

#: A word is a run of anything but these ASCII blanks (fixed by the contracts of ops 3 and 5).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; texts may be long, so it is far below Spark's default.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch, but for a single longer row.
BATCH_BYTES = 4 << 20


#: df written to the shared folder and read again: lineage ends there, and any executor can read it.
settle = written


def open_shared(path: str, how: str):
    """Open a file by its address with pyarrow's file systems, on the driver or an executor: how is in, out or random."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if how == "out":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_file(at) if how == "random" else system.open_input_stream(at, compression=None)


def forget(df: DataFrame) -> None:
    """Remove a table that settle() wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def tune(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch for this session, where the bounds are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for a shuffle of all of df: the session's number, or more if the optimizer's estimate of the size asks for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 200_000)))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with its row's position (from 0) in the order given.

    The order is dealt by ranges; only the number of rows of each range comes to the driver.
    df is evaluated once and should be narrow.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = {r[0]: r[1] for r in dealt.groupBy("_range").count().collect()}
    before, rows = 0, []
    for k in sorted(counts):
        rows.append((k, before))
        before += counts[k]
    offsets = spark.createDataFrame(rows, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, within).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column as one array, and its rows' offsets; a null row is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves 0 when divided by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
