"""Import of documents written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

BLOCK = "struct<id:bigint,kind:string,page:int,level:int,text:string,zh:string,size:double,x0:double,y0:double,x1:double,y1:double,img:string,w:int,h:int>"
SCHEMA = f"format string, title string, enTitle string, pages int, created bigint, fileName string, blocks array<{BLOCK}>"


def parse(texts: DataFrame, zero_based: bool = False) -> DataFrame:
    """texts (doc_id, name, json) with doc, the parsed document; null where it is no JSON or has no blocks.

    Pages in files count from 1 and become places from 0, unless zero_based.
    """
    doc = F.from_json("json", SCHEMA)
    return texts.withColumn("doc", F.when(F.col("json").isNotNull(), doc)).withColumn("doc", F.when(F.col("doc.blocks").isNotNull(), F.col("doc"))).withColumn("shift", F.lit(0 if zero_based else 1))


def blocks(parsed: DataFrame) -> DataFrame:
    """A row for each block: ids default to places, images become bytes."""
    rows = parsed.filter("doc is not null").select("doc_id", "shift", F.posexplode("doc.blocks").alias("place", "b"))
    image = T.from_data_url("b.img")
    return rows.select(
        "doc_id", F.coalesce("b.id", F.col("place").cast("long")).alias("block_id"), "b.kind", "b.text", "b.zh", F.greatest(F.coalesce("b.page", F.lit(1)) - F.col("shift"), F.lit(0)).alias("page"),
        "b.size", "b.level", "b.x0", "b.y0", "b.x1", "b.y1", F.when(F.col("b.img").isNotNull(), image).alias("image"),
    )


def docs(parsed: DataFrame, now: int) -> DataFrame:
    """A row for each document, with defaults for what the file leaves out."""
    most = F.greatest(F.lit(0), F.array_max(F.transform("doc.blocks", lambda b: F.coalesce(b["page"], F.lit(1)))))
    filled = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    return parsed.filter("doc is not null").select(
        F.col("doc_id").alias("id"), filled("doc.title", F.regexp_replace("name", r"(?i)\.json$", "")).alias("title"), F.coalesce("doc.enTitle", F.lit("")).alias("en_title"),
        F.coalesce(F.when(F.col("doc.pages") > 0, F.col("doc.pages")), most).alias("pages"), F.coalesce("doc.created", F.lit(now).cast("long")).alias("created"), filled("doc.fileName", F.col("name")).alias("file_name"), F.lit(True).alias("imported"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files under path as texts (doc_id, name, json)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("json"))
