"""Queries over boxes, ink rows and highlights derived from the tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import boxes as B
from quire.operators import intervals as I

QUERIES = {}
ORACLES = {}

BOXES = """bx AS (SELECT doc_id, j::INT AS j, 0 AS page, CASE (doc_id + j) % 3 WHEN 0 THEN 'graphic' WHEN 1 THEN 'para' ELSE 'caption' END AS kind, (72 + (j % 2) * 20)::DOUBLE AS x0, (60 + 90 * j + doc_id % 17)::DOUBLE AS y0,
 (300 + doc_id % 90)::DOUBLE AS x1, (60 + 90 * j + doc_id % 17 + 30 + (j * 13) % 50)::DOUBLE AS y1 FROM documents, range(0, 6) r(j) WHERE j < doc_id % 6)"""
INK = """ink AS (SELECT doc_id, 0 AS page, y::INT AS y, (7 * y + 13 * doc_id) % 11 < 8 AND NOT (y >= 150 AND y < 170) AS "on", CASE WHEN (7 * y + 13 * doc_id) % 11 < 8 AND NOT (y >= 150 AND y < 170) THEN 36 + y % 5 ELSE -1 END AS min_x,
 CASE WHEN (7 * y + 13 * doc_id) % 11 < 8 AND NOT (y >= 150 AND y < 170) THEN 250 + doc_id % 20 ELSE -1 END AS max_x FROM documents, range(0, 396) r(y))"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {BOXES}, {INK} {sql}"
        return f

    return add


def docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")


def boxes_of(spark, sf_dir) -> DataFrame:
    n = (F.col("doc_id") % 6).cast("int")
    rows = docs(spark, sf_dir).filter(n > 0).withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    k = (F.col("doc_id") + F.col("j")) % 3
    y0 = 60 + 90 * F.col("j") + F.col("doc_id") % 17
    return rows.select(
        "doc_id", "j", F.lit(0).alias("page"), F.when(k == 0, "graphic").when(k == 1, "para").otherwise("caption").alias("kind"), (72 + (F.col("j") % 2) * 20).cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (300 + F.col("doc_id") % 90).cast("double").alias("x1"), (y0 + 30 + (F.col("j") * 13) % 50).cast("double").alias("y1"),
    )


def ink_of(spark, sf_dir) -> DataFrame:
    y = F.col("y")
    on = ((7 * y + 13 * F.col("doc_id")) % 11 < 8) & ~((y >= 150) & (y < 170))
    rows = docs(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(395))))
    return rows.select("doc_id", F.lit(0).alias("page"), "y", on.alias("on"), F.when(on, 36 + y % 5).otherwise(-1).alias("min_x"), F.when(on, (250 + F.col("doc_id") % 20).cast("int")).otherwise(-1).alias("max_x"))


@query("""SELECT user_id, island, min(s) AS start, max(e) AS "end", count(*) AS n, list(event_id ORDER BY s, event_id) AS ids FROM (
 SELECT *, (sum(o) OVER (PARTITION BY user_id ORDER BY s, event_id) - 1)::INT AS island FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o
  FROM (SELECT user_id, event_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events))) GROUP BY user_id, island""")
def merged_highlights(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    marks = events.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("start"), F.expr("ts + INTERVAL 30 MINUTES").alias("end"))
    found = I.islands(marks.withColumns({"start": F.expr("unix_micros(cast(start as timestamp))"), "end": F.expr("unix_micros(cast(end as timestamp))")}), ["user_id"], "start", "end", order=["start", "id"])
    merged = found.groupBy("user_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("start", "id"))), lambda x: x["id"]).alias("ids"))
    return merged.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""SELECT doc_id, page, greatest(min(x0) - 8, 0) AS x0, greatest(min(y0) - 8, 0) AS y0, least(max(x1) + 8, 612) AS x1, least(max(y1) + 8, 792) AS y1, count(*) AS n FROM (
 SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY y0, x0) AS g FROM (
  SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY doc_id ORDER BY y0, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 45 THEN 0 ELSE 1 END AS o FROM bx)) GROUP BY doc_id, page, g HAVING max(y1) - min(y0) >= 8""")
def merged_regions(spark, sf_dir):
    return I.graphic_regions(boxes_of(spark, sf_dir), B.PAGE, gap=45)


COVER = "cov AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, floor(y0 * 0.5) - 1)::BIGINT, least(395, ceil(y1 * 0.5) + 1)::BIGINT + 1)) AS y FROM bx)"


@query(f""", {COVER}, fr AS (SELECT *, y - row_number() OVER (PARTITION BY doc_id ORDER BY y) AS g FROM ink WHERE "on" AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.doc_id = ink.doc_id AND cov.y = ink.y))
SELECT doc_id, page, greatest(0, min(min_x) - 2) / 0.5 AS x0, greatest(0, min(y) - 2) / 0.5 AS y0, least(306, max(max_x) + 3) / 0.5 AS x1, least(396, max(y) + 1 + 2) / 0.5 AS y1 FROM fr GROUP BY doc_id, page, g HAVING count(*) >= 4 AND max(max_x) > min(min_x) + 12""")
def ink_runs(spark, sf_dir):
    covered = I.covered_rows(boxes_of(spark, sf_dir), B.PAGE, 0.5)
    return I.free_runs(ink_of(spark, sf_dir), covered, B.PAGE, least_pt=8)


@query(f""", {COVER} SELECT doc_id, count(*) AS n_rows FROM cov GROUP BY doc_id""")
def covered_rows(spark, sf_dir):
    return I.covered_rows(boxes_of(spark, sf_dir), B.PAGE, 0.5).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


@query("""SELECT doc_id, page, min(y) AS first_y, max(y) AS last_y, count(*) AS n_hot FROM (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY y) AS g FROM (
 SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) <= 6 THEN 0 ELSE 1 END AS o FROM ink WHERE "on")) GROUP BY doc_id, page, g""")
def ink_runs_2d_rows(spark, sf_dir):
    """Hot rows joined over at most 5 that are not."""
    hot = I.runs_with_gaps(ink_of(spark, sf_dir).filter("on"), B.PAGE, 5)
    return hot.groupBy(*B.PAGE, "island").agg(F.min("y").alias("first_y"), F.max("y").alias("last_y"), F.count("*").alias("n_hot")).drop("island")


@query("""SELECT a.doc_id, a.j, count(*) AS n, sum(b.y)::BIGINT AS y_sum FROM bx a JOIN ink b ON a.doc_id = b.doc_id AND b.min_x >= 0 AND b.y * 2 >= a.y0 - 2 AND b.y * 2 <= a.y1 + 2 AND b.min_x * 2 >= a.x0 - 2 GROUP BY 1, 2""")
def items_in_region(spark, sf_dir):
    items = ink_of(spark, sf_dir).filter("min_x >= 0").select("doc_id", "page", (F.col("min_x") * 2.0).alias("x0"), F.lit(0.0).alias("x1"), (F.col("y") * 2.0).alias("y"), F.col("y").alias("row"))
    return B.items_in(boxes_of(spark, sf_dir), items).groupBy("a.doc_id", "a.j").agg(F.count("*").alias("n"), F.sum("b.row").alias("y_sum"))


#: Regions: each document's boxes of every kind merged over gaps of 45 points.
REGIONS = """, rg AS (SELECT doc_id, greatest(min(x0) - 8, 0) AS x0, greatest(min(y0) - 8, 0) AS y0, least(max(x1) + 8, 612) AS x1, least(max(y1) + 8, 792) AS y1 FROM (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY y0, x0) AS g FROM (
 SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY doc_id ORDER BY y0, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 45 THEN 0 ELSE 1 END AS o FROM bx)) GROUP BY doc_id, g HAVING max(y1) - min(y0) >= 8)"""


@query(f"""{REGIONS} SELECT doc_id, j, kind FROM bx t WHERE kind <> 'graphic' AND NOT EXISTS (SELECT 1 FROM rg r WHERE r.doc_id = t.doc_id AND r.y1 - r.y0 >= 80 AND t.y0 >= r.y0 - 2 AND t.y1 <= r.y1 + 2 AND t.x0 >= r.x0 - 8 AND t.x1 <= r.x1 + 8)""")
def region_absorb_anti(spark, sf_dir):
    found = boxes_of(spark, sf_dir)
    regions = I.graphic_regions(found, B.PAGE, gap=45)
    return B.not_swallowed(found.filter("kind <> 'graphic'"), regions).select("doc_id", "j", "kind")


H_OVERLAP = "CASE WHEN least(g.x1, c.x1) - greatest(g.x0, c.x0) > 0 THEN (least(g.x1, c.x1) - greatest(g.x0, c.x0)) / least(g.x1 - g.x0, c.x1 - c.x0) ELSE 0 END"


@query(f"""SELECT doc_id, j FROM bx c WHERE kind = 'caption' AND NOT EXISTS (SELECT 1 FROM bx g WHERE g.kind = 'graphic' AND g.doc_id = c.doc_id AND {H_OVERLAP} > 0.25 AND c.y0 - g.y1 < 150 AND g.y0 - c.y1 < 150)""")
def missing_figures(spark, sf_dir):
    found = boxes_of(spark, sf_dir)
    return B.without_figure(found.filter("kind = 'caption'"), found.filter("kind = 'graphic'")).select("doc_id", "j")


@query(f"""SELECT c.doc_id, c.j AS j, g.j AS other, {H_OVERLAP} AS h_overlap,
 CASE WHEN least(c.x1, g.x1) > greatest(c.x0, g.x0) AND least(c.y1, g.y1 + 40) > greatest(c.y0, g.y0) THEN (least(c.x1, g.x1) - greatest(c.x0, g.x0)) * (least(c.y1, g.y1 + 40) - greatest(c.y0, g.y0)) / greatest((c.x1 - c.x0) * (c.y1 - c.y0), 1) ELSE 0 END AS overlap,
 CASE WHEN least(c.y1, g.y1 + 40) > greatest(c.y0, g.y0) THEN (least(c.y1, g.y1 + 40) - greatest(c.y0, g.y0)) / greatest(1, g.y1 + 40 - g.y0) ELSE 0 END AS y_overlap
 FROM bx c JOIN bx g ON c.doc_id = g.doc_id AND c.j <> g.j""")
def box_overlaps(spark, sf_dir):
    found = boxes_of(spark, sf_dir)
    taller = found.withColumn("y1", F.col("y1") + 40)
    a, b = B.box("a"), B.box("b")
    pairs = B.on_same_page(found, taller, F.col("a.j") != F.col("b.j"))
    return pairs.select("a.doc_id", "a.j", F.col("b.j").alias("other"), B.h_overlap(b, a).alias("h_overlap"), B.overlap_ratio(a, b).alias("overlap"), B.y_overlap(a, b).alias("y_overlap"))


#: One tall graphic or a paragraph for each page, low or high on it.
CHAIN = """ch AS (SELECT doc_id, p::INT AS page, p::INT AS seq, CASE WHEN (doc_id * 3 + p) % 5 = 0 THEN 'para' ELSE 'graphic' END AS kind, (60 + (doc_id + p) % 3 * 90)::DOUBLE AS x0, 60.0::DOUBLE AS y0, 400.0::DOUBLE AS x1, (600 + (doc_id + p) % 4 * 50)::DOUBLE AS y1 FROM documents, range(0, 8) r(p))"""


@query(f""", {CHAIN}, nx AS (SELECT *, lead(kind) OVER w AS nk, lead(page) OVER w AS np, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1 FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
f AS (SELECT *, coalesce(kind = 'graphic' AND nk = 'graphic' AND 792 - y1 < 135 AND ny0 < 135 AND least(x1, nx1) - greatest(x0, nx0) > 0.55 * (greatest(x1, nx1) - least(x0, nx0)) AND y1 - y0 > 50 AND ny1 - ny0 > 50, false) AS fits FROM nx),
c AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS chain FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY seq) AS place FROM c WHERE fits)
SELECT doc_id, seq, seq + 1 AS with_seq, page FROM p WHERE place % 2 = 1""")
def stitch_pairs(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(7))))
    k = F.col("doc_id") + F.col("page")
    blocks = rows.select(
        "doc_id", "page", F.col("page").alias("seq"), F.when((F.col("doc_id") * 3 + F.col("page")) % 5 == 0, "para").otherwise("graphic").alias("kind"),
        (60 + k % 3 * 90).cast("double").alias("x0"), F.lit(60.0).alias("y0"), F.lit(400.0).alias("x1"), (600 + k % 4 * 50).cast("double").alias("y1"),
    ).withColumn("h", F.col("y1") - F.col("y0"))
    dims = rows.select("doc_id", "page", F.lit(792.0).alias("height"))
    return B.stitch_pairs(blocks, dims)


@query("""SELECT a.doc_id, a.j, min(b.j) AS before_j FROM bx a LEFT JOIN bx b ON a.doc_id = b.doc_id AND b.kind <> 'graphic' AND b.y0 > a.y0 WHERE a.kind = 'graphic' GROUP BY a.doc_id, a.j""")
def figure_places(spark, sf_dir):
    """The first block of a page that starts below each figure, before which the figure is put; null: at the end."""
    found = boxes_of(spark, sf_dir)
    below = B.on_same_page(found.filter("kind = 'graphic'"), found.filter("kind <> 'graphic'"), F.col("b.y0") > F.col("a.y0"), "left")
    return below.groupBy("a.doc_id", "a.j").agg(F.min("b.j").alias("before_j"))


@query("""SELECT doc_id, j, kind, (row_number() OVER (PARTITION BY doc_id ORDER BY c, floor(y0 / 3 + 0.5), x0, j) - 1)::INT AS place FROM (SELECT *, CASE WHEN j % 3 = 0 THEN -1 ELSE j % 2 END AS c FROM bx)""")
def reading_order(spark, sf_dir):
    """Blocks across the page first, then column by column; a column is null across the page."""
    from quire.operators.blocks import reading_order as order

    found = boxes_of(spark, sf_dir).withColumn("col", F.when(F.col("j") % 3 == 0, F.lit(None)).otherwise(F.col("j") % 2).cast("int"))
    return order(found, "j").select("doc_id", "j", "kind", "place")
