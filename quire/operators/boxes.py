"""Boxes on pages: overlaps, containment and nearness, joined on (doc_id, page) with the geometry as a residual condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
EDGES = ("x0", "y0", "x1", "y1")


def box(alias: str | None = None) -> tuple[Column, ...]:
    return tuple(F.col(f"{alias}.{e}" if alias else e) for e in EDGES)


def overlap_ratio(a: tuple, b: tuple) -> Column:
    """The share of a's area that b covers."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h / F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1.0))).otherwise(0.0)


def h_overlap(a: tuple, b: tuple) -> Column:
    """Common width over the smaller width; 0 where either has none."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    return F.when(w > 0, w / F.least(a[2] - a[0], b[2] - b[0])).otherwise(0.0)


def y_overlap(a: tuple, b: tuple) -> Column:
    """Common height over b's height, taken as 1 at least."""
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when(h > 0, h / F.greatest(F.lit(1.0), b[3] - b[1])).otherwise(0.0)


def on_same_page(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join of frames aliased a and b where condition holds; the page is the hash key."""
    keys = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page"))
    return left.alias("a").join(right.alias("b"), keys & condition, how)


def items_in(regions: DataFrame, items: DataFrame, pad_x: float = 2, pad_y: float = 2) -> DataFrame:
    """Regions with the items (x0, x1, y) whose baseline is in the padded region."""
    a = box("a")
    inside = (F.col("b.y") >= a[1] - pad_y) & (F.col("b.y") <= a[3] + pad_y) & (F.col("b.x0") >= a[0] - pad_x) & (F.col("b.x1") <= a[2] + pad_x)
    return on_same_page(regions, items, inside)


def not_swallowed(texts: DataFrame, regions: DataFrame, tall: float = 80) -> DataFrame:
    """Texts that no tall region holds."""
    t, r = box("a"), box("b")
    held = (r[3] - r[1] >= tall) & (t[1] >= r[1] - 2) & (t[3] <= r[3] + 2) & (t[0] >= r[0] - 8) & (t[2] <= r[2] + 8)
    return on_same_page(texts, regions, held, "left_anti")


def without_figure(captions: DataFrame, figures: DataFrame, reach: float = 150, least: float = 0.25) -> DataFrame:
    """Captions with no figure that overlaps them sideways and is near up or down the page."""
    c, g = box("a"), box("b")
    near = (h_overlap(g, c) > least) & (c[1] - g[3] < reach) & (g[1] - c[3] < reach)
    return on_same_page(captions, figures, near, "left_anti")


def not_under_banner(lines: DataFrame, banners: DataFrame) -> DataFrame:
    return on_same_page(lines, banners, y_overlap(box("b"), box("a")) > 0.5, "left_anti")


def stitch_pairs(blocks: DataFrame, dims: DataFrame, margin: float = 135, alike: float = 0.55, tall: float = 50) -> DataFrame:
    """Graphics cut in two by a page's end: consecutive blocks of consecutive pages. A block that was taken as a second half starts no pair.

    blocks: doc_id, seq, kind, page and box, h; dims: doc_id, page, height.
    """
    b = blocks.join(dims, PAGE, "left")
    w = Window.partitionBy("doc_id").orderBy("seq")
    nxt = {c: F.lead(c).over(w) for c in ("kind", "page", *EDGES, "h", "seq")}
    s = b.select("*", *[v.alias(f"n_{k}") for k, v in nxt.items()])
    both = F.least("x1", "n_x1") - F.greatest("x0", "n_x0")
    span = F.greatest("x1", "n_x1") - F.least("x0", "n_x0")
    fits = (
        (F.col("kind") == "graphic") & (F.col("n_kind") == "graphic") & (F.col("n_page") == F.col("page") + 1) & (F.col("height") - F.col("y1") < margin)
        & (F.col("n_y0") < margin) & (span > 0) & (both > alike * span) & (F.col("h") > tall) & (F.col("n_h") > tall)
    )
    s = s.withColumn("fits", F.coalesce(fits, F.lit(False)))
    # in a chain of fitting pairs every other one counts, from the first
    chain = F.sum(F.when(~F.col("fits"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("seq"))
    s = s.withColumn("chain", chain).filter("fits").withColumn("place", place)
    return s.filter(F.col("place") % 2 == 1).select("doc_id", "seq", F.col("n_seq").alias("with_seq"), "page")
