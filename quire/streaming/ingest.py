"""Incremental ingest: new files are read as a stream and put through the batch plans, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def ingest(spark: SparkSession, source: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.parquet", files_per_batch: int = 64) -> None:
    """Give every file under source that hasn't been seen to `each`, and end when there are none left.

    What has been seen is in the checkpoint, so that a restart goes on; `each` gets the batch's number, by which it can
    make its writing idempotent.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted(batch: DataFrame) -> DataFrame:
    """Per source, its documents, lines and characters: sums that batches can be added up by."""
    return batch.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(F.length("text")).alias("chars"))
