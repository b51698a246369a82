"""Hand-written scripts of a document: parsing, checking, and building an importable document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.text import data_url

#: Tags that open a block, its kind and a heading's level.
TAGS = {"h1": ("heading", 1), "h2": ("heading", 2), "h3": ("heading", 3), "p": ("para", None), "note": ("note", None), "cap": ("caption", None), "math": ("math", None), "ref": ("ref", None)}
FORMAT = "quire/doc@1"


def tagged_lines(scripts: DataFrame) -> DataFrame:
    """doc_id, line_no, line, tag, arg, region (the tag that governs a line), region_no and page, of scripts (doc_id, text)."""
    lines = scripts.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", F.rtrim("raw").alias("line"))
    tag = F.regexp_extract("line", r"^@(\w+)(?:\s+(.*))?$", 1)
    lines = lines.withColumns({"tag": F.when(tag != "", tag), "arg": T.trim(F.regexp_extract("line", r"^@(\w+)(?:\s+(.*))?$", 2))})
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = F.last(F.when(F.col("tag") == "page", F.expr("try_cast(arg as int)")), ignorenulls=True).over(upto)
    return lines.withColumns({"region": F.last("tag", ignorenulls=True).over(upto), "region_no": F.count("tag").over(upto), "page": F.coalesce(page, F.lit(1))})


def faults(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, fault: unknown tags, figures without four coordinates, text outside of blocks."""
    known = [*TAGS, "meta", "page", "fig"]
    four = F.size(F.filter(F.split("arg", r"[,\s]+", -1), lambda x: x.rlike(r"^-?[0-9]*\.?[0-9]+$"))) == 4
    stray = F.col("tag").isNull() & (F.trim("line") != "") & (F.col("region").isNull() | F.col("region").isin("page", "fig"))
    fault = F.when(F.col("tag").isNotNull() & ~F.col("tag").isin(known), "unknown tag").when((F.col("tag") == "fig") & ~four, "figure needs four coordinates").when((F.col("tag") == "page") & ~F.col("arg").rlike("^[0-9]+$"), "page needs a number").when(stray, "text outside of a block")
    return lines.withColumn("fault", fault).filter("fault is not null").select("doc_id", "line_no", "fault")


def meta(lines: DataFrame) -> DataFrame:
    """doc_id, key, value of the lines under @meta; the last of a key counts."""
    rows = lines.filter((F.col("region") == "meta") & F.col("tag").isNull() & F.contains("line", F.lit(":")))
    key, value = T.trim(F.substring_index("line", ":", 1)), T.trim(F.regexp_replace("line", "^[^:]*:", ""))
    return rows.groupBy("doc_id", key.alias("key")).agg(F.max_by(value, "line_no").alias("value"))


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block_id, kind, level, page (from 1), text, zh, x0..y1: the blocks in order; an empty one is left out."""
    body = lines.filter(F.col("region").isin(*TAGS)).groupBy("doc_id", "region_no").agg(
        F.first(F.when(F.col("tag").isNotNull(), F.col("tag")), ignorenulls=True).alias("tag"), F.min("page").alias("page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    body = body.withColumn("body", T.trim("body")).filter("body <> ''")
    parts = F.split("body", "\n--\n", 2)
    texts = body.select("doc_id", "region_no", "page", pick(0).alias("kind"), pick(1).cast("int").alias("level"), T.trim(parts[0]).alias("text"), T.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("zh"), F.lit(None).cast("array<double>").alias("box"))
    number = F.transform(F.filter(F.split("arg", r"[,\s]+", -1), lambda x: x != ""), lambda x: x.cast("double"))
    figures = lines.filter("tag = 'fig'").select("doc_id", "region_no", "page", F.lit("graphic").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), F.lit(None).cast("string").alias("zh"), number.alias("box"))
    rows = texts.unionByName(figures)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("region_no")) - 1
    box = [F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("doc_id", number.cast("long").alias("block_id"), "kind", "level", "page", "text", "zh", *box)


def pick(place: int) -> Column:
    out = F.lit(None).cast("string")
    for tag, values in TAGS.items():
        out = F.when(F.col("tag") == tag, F.lit(values[place]).cast("string")).otherwise(out)
    return out


def document(found: DataFrame, facts: DataFrame, created: int, crops: DataFrame | None = None) -> DataFrame:
    """doc_id, json: importable documents. Pages are the largest page number. crops (doc_id, block_id, w, h, image): pictures of blocks, put in as data URLs."""
    if crops is not None:
        pictures = crops.select("doc_id", "block_id", "w", "h", data_url(F.lit("image/png"), F.col("image")).alias("img"))
        found = found.join(pictures, ["doc_id", "block_id"], "left")
    shown = ["img", "w", "h"] if crops is not None else []
    rows = found.groupBy("doc_id").agg(F.max("page").alias("pages"), F.array_sort(F.collect_list(F.struct(F.col("block_id").alias("id"), "kind", "page", "level", "text", "zh", "x0", "y0", "x1", "y1", *shown))).alias("blocks"))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    named = facts.groupBy("doc_id").agg(value("title-zh").alias("zh_title"), value("title-en").alias("en_title"), value("file").alias("file"))
    all_ = rows.join(named, "doc_id", "left")
    out = F.struct(F.lit(FORMAT).alias("format"), F.coalesce("zh_title", "en_title", F.lit("untitled")).alias("title"), F.coalesce("en_title", F.lit("")).alias("enTitle"), "pages", F.lit(created).cast("long").alias("created"), F.coalesce("file", F.lit("")).alias("fileName"), "blocks")
    return all_.select("doc_id", F.to_json(out).alias("json"))


def kind_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("zh", F.lit("")) != "").alias("translated"))
