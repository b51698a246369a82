"""Blocks in reading order: places, titles, tables of contents, sections, contexts and document-wide tidying."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T


def reading_order(blocks: DataFrame, seq: str = "seq") -> DataFrame:
    """blocks with `place` on their page: across the page first, then by column, then down in steps of 3 points."""
    order = [F.coalesce("col", F.lit(-1)), F.floor(F.col("y0") / 3 + 0.5), F.col("x0"), F.col(seq)]
    return blocks.withColumn("place", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)) - 1).cast("int"))


def title(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, title: the largest heading of the first two pages, the first of equal ones."""
    early = blocks.filter((F.col("kind") == "heading") & (F.col("page") <= 1))
    best = early.groupBy("doc_id").agg(F.max_by(F.struct("block_id", F.coalesce("zh", "text").alias("title")), F.struct("size", F.negative("block_id"))).alias("t"))
    return best.select("doc_id", "t.block_id", "t.title")


def contents(blocks: DataFrame) -> DataFrame:
    """The table of contents: headings with level, anchor and text, without a title that is a heading of the first level."""
    named = title(blocks).select("doc_id", F.col("block_id").alias("title_id"))
    heads = blocks.filter("kind = 'heading'").join(named, "doc_id", "left")
    level = F.coalesce(F.col("level"), T.level_by_size(F.coalesce("size", F.lit(12.0)))) if "level" in blocks.columns else T.level_by_size(F.coalesce("size", F.lit(12.0)))
    shown = F.coalesce("zh", "text")
    kept = heads.filter(~((F.col("block_id") == F.col("title_id")) & (level == 1)))
    return kept.select("doc_id", "block_id", level.alias("level"), T.slug(shown, "block_id").alias("anchor"), shown.alias("text"))


def sections(blocks: DataFrame) -> DataFrame:
    """blocks with `section`, the last heading at or before each, empty where there is none."""
    upto = Window.partitionBy("doc_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("kind") == "heading", F.coalesce("zh", "text"))
    return blocks.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(upto), F.lit("")))


def context(blocks: DataFrame, asked: DataFrame, radius: int = 3, in_order: bool = False) -> DataFrame:
    """doc_id, block_id, context for asked (doc_id, block_id): of the blocks at most 3 radius away the 2 radius nearest.

    Nearest first, the earlier of two equally near; in_order gives them in the document's order instead.
    """
    reach = 3 * radius
    wanted = asked.select("doc_id", F.col("block_id").alias("about"), F.explode(F.sequence(F.col("block_id") - reach, F.col("block_id") + reach)).alias("block_id"))
    texts = blocks.filter(F.col("kind").isin(*X.TRANSLATED_KINDS) & (F.coalesce("text", F.lit("")) != ""))
    near = wanted.join(texts, ["doc_id", "block_id"]).withColumn("far", F.abs(F.col("block_id") - F.col("about")))
    rank = F.row_number().over(Window.partitionBy("doc_id", "about").orderBy("far", "block_id"))
    picked = near.withColumn("rank", rank).filter(F.col("rank") <= 2 * radius)
    shown = F.when(F.coalesce("zh", F.lit("")) != "", F.concat("zh", F.lit("\n（原文："), "text", F.lit("）"))).otherwise(F.col("text"))
    place = F.col("block_id") if in_order else F.col("rank").cast("long")
    parts = F.array_sort(F.collect_list(F.struct(place.alias("p"), shown.alias("s"))))
    return picked.groupBy("doc_id", F.col("about").alias("block_id")).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n\n").alias("context"))


def references(blocks: DataFrame, model: bool = False, end_size: float = 17.0) -> DataFrame:
    """blocks of the reference section as ref, its graphics dropped (kept where model).

    The section is opened by a heading that says so and ends at the next large heading: of end_size at least, or
    where model of nearly the opening heading's size. Only the first such section counts.
    """
    said = F.regexp_replace(T.trim("text"), r"\*+\z", "") == "References"
    if model:
        said = T.trim("text").rlike("(?i)^(references|bibliography|参考文献)(?![A-Za-z0-9_])")
    w = Window.partitionBy("doc_id").orderBy("block_id")
    opens = (F.col("kind") == "heading") & said
    b = blocks.withColumn("_open", F.min(F.when(opens, F.col("block_id"))).over(Window.partitionBy("doc_id")))
    least = F.first(F.when(F.col("block_id") == F.col("_open"), F.coalesce("size", F.lit(12.0))), ignorenulls=True).over(Window.partitionBy("doc_id")) - 0.4 if model else F.lit(end_size)
    b = b.withColumn("_least", least)
    ends = (F.col("block_id") > F.col("_open")) & (F.col("kind") == "heading") & (F.coalesce("size", F.lit(0.0)) >= F.col("_least"))
    b = b.withColumn("_ended", F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    inside = F.coalesce((F.col("block_id") > F.col("_open")) & (F.col("_ended") == 0), F.lit(False))
    kind = F.when(inside & F.col("kind").isin("para", "note"), "ref").when(inside & (F.col("kind") == "graphic") & F.lit(not model), "drop").otherwise(F.col("kind"))
    return b.withColumn("kind", kind).filter("kind <> 'drop'").drop("_open", "_least", "_ended")


def bylines(blocks: DataFrame, first: int = 8) -> DataFrame:
    """Headings among a document's first blocks with three commas or more are bylines, not to be translated."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_id"))
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    b = blocks.withColumn("_p", place)
    return b.withColumn("kind", F.when((F.col("_p") <= first) & (F.col("kind") == "heading") & (commas >= 3), "ref").otherwise(F.col("kind"))).drop("_p")


def renumbered(blocks: DataFrame) -> DataFrame:
    """block_id dense from 0 in the same order."""
    return blocks.withColumn("block_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block_id")) - 1).cast("long"))
