"""Text items as a PDF library gives them, as spans: all expressions.

items: doc_id, page, seq, str, a, b, c, d, e, f (the item's transform), width, font (a name, perhaps with a subset's
prefix) and vp (ARRAY of the viewport's six numbers); scale is the viewport's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def transformed() -> dict[str, F.Column]:
    """The product of viewport and item transforms: its c, d, e and f."""
    v = [F.col("vp")[i] for i in range(6)]
    return {
        "tc": v[0] * F.col("c") + v[2] * F.col("d"), "td": v[1] * F.col("c") + v[3] * F.col("d"),
        "te": v[0] * F.col("e") + v[2] * F.col("f") + v[4], "tf": v[1] * F.col("e") + v[3] * F.col("f") + v[5],
    }


def spans(items: DataFrame, scale: float = 1.0, rounded: bool = True, up: float = 0.78, down: float = 0.24) -> DataFrame:
    """Spans of items that aren't blank. For a model's pages sizes stay unrounded and lines reach from 0.85 up to 0.3 down."""
    t = transformed()
    size = F.hypot(t["tc"], t["td"]) / scale
    x0, y = t["te"] / scale, t["tf"] / scale
    kept = items.filter(T.trim(F.coalesce("str", F.lit(""))) != "")
    return kept.select(
        "doc_id", "page", "seq", "str", (F.floor(size * 10 + 0.5) / 10 if rounded else size).alias("size"), F.element_at(F.split(F.coalesce("font", F.lit("")), r"\+"), -1).alias("font"),
        x0.alias("x0"), (x0 + F.coalesce("width", F.lit(0.0))).alias("x1"), y.alias("y_base"), (y - up * size).alias("y_top"), (y + down * size).alias("y_bot"),
    )


def drawing_census(items: DataFrame, drawings: DataFrame, images: DataFrame, many: int = 40) -> DataFrame:
    """doc_id, page, texts, drawings, images, y_from, y_to, likely_figures, of text items, drawings (y0, y1) and images."""
    keys = ["doc_id", "page"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    drawn = drawings.groupBy(*keys).agg(F.count("*").alias("drawings"), F.min("y0").alias("y_from"), F.max("y1").alias("y_to"))
    rows = n(items, "texts").join(drawn, keys, "full").join(n(images, "images"), keys, "full")
    rows = rows.na.fill(0, ["texts", "drawings", "images"])
    return rows.withColumn("likely_figures", (F.col("images") > 0) | (F.col("drawings") > many))
