"""The library: documents with their blocks, files, highlights and notes, kept as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T

VERSION = 2
TABLES = {
    "docs": "id long, title string, en_title string, pages int, created long, file_name string, imported boolean",
    "blocks": "doc_id long, block_id long, kind string, text string, zh string, page int, size double, level int, x0 double, y0 double, x1 double, y1 double",
    "files": "doc_id long, content binary",
    "highlights": "id long, doc_id long, block_id long, field string, start int, end int, text string, created long",
    "cache": "k string, zh string",
}


class Library:
    """Tables under a folder. Documents' tables are partitioned by doc_id, so that putting a document replaces its own partition only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root, self.folder = spark, folder, f"{folder}/v{VERSION}"

    def open(self) -> Library:
        """The library, ready to be written: missing tables are made, and an older version's tables are taken over.

        A folder that a later version has written is refused: its tables may mean something else.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        versions = sorted(int(v[1:]) for v in there if re.fullmatch(r"v[0-9]+", v))
        if versions and versions[-1] > VERSION:
            raise ValueError(f"{self.root} was written by version {versions[-1]} of the library; this is version {VERSION}")
        older = versions[-1] if versions and versions[-1] < VERSION else None
        at = lambda version, name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{version}/{name}")
        for name, schema in TABLES.items():
            if fs.exists(at(VERSION, name)):
                continue
            rows = self.spark.createDataFrame([], schema)
            if older is not None and fs.exists(at(older, name)):
                rows = rows.unionByName(self.spark.read.parquet(f"{self.root}/v{older}/{name}"), allowMissingColumns=True).select(rows.columns)
            rows.write.parquet(f"{self.folder}/{name}") if name == "cache" else self.put(name, rows)
        return self

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def put(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions of the documents in rows."""
        key = "id" if name == "docs" else "doc_id"
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{self.folder}/{name}")

    def drop(self, doc_id: int) -> None:
        """A document goes with all that belongs to it."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in ("docs", "blocks", "files", "highlights"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{'id' if name == 'docs' else 'doc_id'}={doc_id}")
            path.getFileSystem(conf).delete(path, True)

    def remember(self, fresh: DataFrame) -> None:
        """Add cache rows whose keys are new."""
        known = self.table("cache").select("k")
        fresh.join(known, "k", "left_anti").dropDuplicates(["k"]).write.mode("append").parquet(f"{self.folder}/cache")

    def forget(self) -> None:
        self.spark.createDataFrame([], TABLES["cache"]).write.mode("overwrite").parquet(f"{self.folder}/cache")

    def usage(self) -> int:
        """Bytes used."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def listing(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents with their numbers of blocks and of translated ones, the newest first. Texts are not read."""
    counts = blocks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_blocks"), F.count_if(F.coalesce("zh", F.lit("")) != "").alias("n_translated"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.join(counts, "id", "left").select(*docs.columns, zero("n_blocks"), zero("n_translated")).orderBy(F.desc("created"), "id")


def pending_counts(blocks: DataFrame) -> DataFrame:
    wanted = F.col("kind").isin(*X.TRANSLATED_KINDS) & (T.trim(F.coalesce("text", F.lit(""))) != "")
    return blocks.groupBy("doc_id").agg(F.count_if(wanted & (F.coalesce("zh", F.lit("")) == "")).alias("pending"), F.count_if(F.coalesce("zh", F.lit("")) != "").alias("translated"), F.count("*").alias("blocks"))


def notes(highlights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Highlights in the order of their blocks and starts; one whose block is gone counts as of block place 0."""
    place = blocks.select("doc_id", "block_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block_id")) - 1).alias("block_place"))
    found = highlights.join(place, ["doc_id", "block_id"], "left").withColumn("block_place", F.coalesce("block_place", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_place", "start", "id"))
    return found.withColumn("note", (rank - 1).cast("int"))


def without_overlapping(highlights: DataFrame, erased: DataFrame) -> DataFrame:
    """Highlights that no erased range (doc_id, block_id, field, start, end) overlaps."""
    same = [F.col(f"h.{c}") == F.col(f"e.{c}") for c in ("doc_id", "block_id", "field")]
    return highlights.alias("h").join(erased.alias("e"), [*same, F.col("h.start") < F.col("e.end"), F.col("h.end") > F.col("e.start")], "left_anti")


def painted(texts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, marked, source: texts cut by merged ranges (start, end) into marked and plain pieces, in order."""
    marks = F.array_sort(F.collect_list(F.struct("start", "end")))
    rows = texts.join(ranges.groupBy(*keys).agg(marks.alias("marks")), keys, "left")
    n = F.length("text")
    cut = F.transform(F.coalesce("marks", F.array().cast("array<struct<start:int,end:int>>")), lambda m: F.struct(F.greatest(F.lit(0), F.least(m["start"], n)).alias("a"), F.greatest(F.greatest(F.lit(0), F.least(m["start"], n)), F.least(m["end"], n)).alias("b")))
    rows = rows.withColumn("cut", cut)
    piece = lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("cut"), i - 1)["b"])
    pairs = F.transform("cut", lambda m, i: F.array(F.struct(F.lit(False).alias("marked"), piece(before(i), m["a"]).alias("source")), F.struct(F.lit(True).alias("marked"), piece(m["a"], m["b"]).alias("source"))))
    end = F.when(F.size("cut") > 0, F.element_at(F.col("cut"), -1)["b"]).otherwise(F.lit(0))
    rest = F.array(F.array(F.struct(F.lit(False).alias("marked"), piece(end, n).alias("source"))))
    pieces = F.filter(F.flatten(F.concat(pairs, rest)), lambda s: s["marked"] | (s["source"] != ""))
    return rows.select(*keys, F.posexplode(pieces).alias("k", "s")).select(*keys, "k", "s.marked", "s.source")


def source_offset(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments (keys, k, kind, source) with `at`, where each begins in the source text: rendered formulas count by their source."""
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("at", F.coalesce(F.sum(F.length("source")).over(before), F.lit(0)))


def wire(messages: DataFrame, context: DataFrame | None = None, system: str = "") -> DataFrame:
    """conv_id, messages: what is sent for each conversation. The first user turn carries the context (conv_id, context), in every later request too."""
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    if context is not None:
        first = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) == 1
        rows = rows.join(context, "conv_id", "left").withColumn("text", F.when(first & (F.col("role") == "user") & F.col("context").isNotNull(), F.concat("context", F.lit("\n\n"), "text")).otherwise(F.col("text")))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))) if system else F.array().cast("array<struct<role:string,content:string>>")
    return rows.groupBy("conv_id").agg(F.concat(head, turns).alias("messages"))


def translated_titles(blocks: DataFrame) -> DataFrame:
    """doc_id, title: the translation of the first heading that has one, without asterisks at its end."""
    named = blocks.filter((F.col("kind") == "heading") & (T.trim(F.coalesce("zh", F.lit(""))) != ""))
    return named.groupBy("doc_id").agg(F.regexp_replace(F.min_by("zh", "block_id"), r"\*+\z", "").alias("title"))


def first_of(rows: DataFrame, by: list[str], order: list, most: int = 6) -> DataFrame:
    """The first `most` rows of each group, with `place` from 1 and `more`, how many there are beyond.

    Ranks are limited before rows are shuffled, and counts are added up before, so a large group is in no one task.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = rows.withColumn("place", place).filter(F.col("place") <= most)
    more = rows.groupBy(*by).agg(F.greatest(F.lit(0).cast("long"), F.count("*") - most).alias("more"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    return first.alias("f").join(more.alias("m"), same).select("f.*", "m.more")


def new_id(millis: Column, seed: Column) -> Column:
    """An id for a document: d, the time in base 36, and five letters of the seed's digest. With a random seed (uuid()) ids are new; with a key they can be made again."""
    return F.concat(F.lit("d"), F.lower(F.conv(millis.cast("string"), 10, 36)), F.substring(F.md5(seed.cast("string").cast("binary")), 1, 5))


def debounced(saves: DataFrame, by: list[str], at: str, quiet: str = "400 milliseconds") -> DataFrame:
    """The saves that are written: of those that follow one another within `quiet`, the last. Works on streams with a watermark on `at` too.

    by, start, end, saves (how many were put together) and last (a struct of all columns of the one that is written).
    """
    last = F.max_by(F.struct(*saves.columns), F.col(at))
    found = saves.groupBy(*by, F.session_window(at, quiet).alias("session")).agg(F.count("*").alias("saves"), last.alias("last"))
    return found.select(*by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "saves", "last")
