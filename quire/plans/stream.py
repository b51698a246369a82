"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources.tables import new_path
from quire.streaming import ingest as S

QUERIES = {}
ORACLES = {}


def stream_ingest_counts(spark, sf_dir):
    """documents read as a stream of files; each batch's counts are written under its number and added up at the end."""
    out = new_path(spark, "stream")

    def each(batch, number: int) -> None:
        S.counted(batch).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    # a table is a file or a folder of files
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    folder_like = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    S.ingest(spark, f"{sf_dir}/documents.parquet" if folder_like else sf_dir, S.DOCUMENTS, each, f"{out}/checkpoint", "*.parquet" if folder_like else "documents.parquet")
    rows = spark.read.option("basePath", f"{out}/counts").parquet(f"{out}/counts")
    return rows.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("documents", "lines", "chars")])


QUERIES["stream_ingest_counts"] = stream_ingest_counts
ORACLES["stream_ingest_counts"] = "SELECT source, count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source"
