"""Queries over typeset documents: spans, lines, histograms, learned layout, kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T
from quire.operators import classify, profile
from quire.plans import text as P
from quire.sources import typeset as TS
from quire.sources.tables import written

QUERIES = {}
ORACLES = {}
H = f"{TS.PAGE_HEIGHT}::DOUBLE"
UP = lambda e, d=0: f"(floor(({e}) * {10**d} + 0.5) / {10**d})" if d else f"floor(({e}) + 0.5)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {TS.SQL}{sql}"
        return f

    return add


def spans_of(spark, sf_dir, **how) -> DataFrame:
    return TS.typeset(P.documents(spark, sf_dir), **how)


def written_spans(spark, sf_dir) -> DataFrame:
    """Spans as a table, as a plan has them that reads them more than once: elsewhere they are the input."""
    return written(spans_of(spark, sf_dir), "spans")


@query("SELECT * FROM spans")
def spans_typeset(spark, sf_dir):
    return spans_of(spark, sf_dir)


def lines_of(spans: DataFrame) -> DataFrame:
    """Lines where baselines are discrete: spans of one baseline are a line. (operators.pages folds drifting baselines.)"""
    part = F.array_sort(F.collect_list(F.struct("x0", "seq", "str")))
    lines = spans.groupBy("doc_id", "page", "y_base").agg(
        F.regexp_replace(F.array_join(F.transform(part, lambda p: p["str"]), ""), f"{X.WS}+", " ").alias("_text"),
        F.max("size").alias("size"), F.max_by("font", "size").alias("font"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y_top").alias("y_top"), F.max("y_bot").alias("y_bot"),
    )
    return lines.withColumn("text", F.trim("_text")).drop("_text")


LINES = f""", lines AS (SELECT doc_id, page, y_base, {P.COLLAPSE("string_agg(str, '' ORDER BY x0, seq)")} AS text, max(size) AS size, arg_max(font, size) AS font,
 min(x0) AS x0, max(x1) AS x1, min(y_top) AS y_top, max(y_bot) AS y_bot FROM spans GROUP BY doc_id, page, y_base)"""


@query(f"{LINES} SELECT * FROM lines")
def lines(spark, sf_dir):
    return lines_of(spans_of(spark, sf_dir))


@query(f"SELECT doc_id, {UP('size', 1)} AS size, sum(length(str))::BIGINT AS chars FROM spans WHERE {UP('size', 1)} BETWEEN 4 AND 40 GROUP BY 1, 2")
def size_profile(spark, sf_dir):
    return profile.size_histogram(spans_of(spark, sf_dir)).drop("first")


ROWS = f""", starts AS (SELECT doc_id, page, {UP('y_base')}::BIGINT AS row, min(x0) AS x, arg_min(y_base, seq) AS y, string_agg(str, '' ORDER BY seq) AS text FROM spans GROUP BY 1, 2, 3)"""


@query(f"{ROWS} SELECT doc_id, ({UP('x / 2')} * 2)::BIGINT AS x, count(*) AS n FROM starts GROUP BY 1, 2")
def x_histogram(spark, sf_dir):
    return profile.x_histogram(profile.row_starts(spans_of(spark, sf_dir)))


EDGES = f"""{ROWS}, edges AS (SELECT doc_id, {P.EDGE_KEY('text')} AS edge_key, count(*) AS n FROM starts WHERE y < {H} * 0.09 OR y > {H} * 0.91 GROUP BY 1, 2)"""


@query(f"{EDGES} SELECT * FROM edges WHERE length(edge_key) >= 3")
def edge_texts(spark, sf_dir):
    return profile.edge_texts(profile.row_starts(spans_of(spark, sf_dir)), TS.PAGE_HEIGHT)


PAGES = ", n AS (SELECT doc_id, max(page) + 1 AS n_pages FROM spans GROUP BY doc_id), w AS (SELECT doc_id, CASE WHEN n_pages > 6 THEN floor(n_pages * 0.2) ELSE 0 END AS start, least(n_pages - CASE WHEN n_pages > 6 THEN floor(n_pages * 0.2) ELSE 0 END, 14) AS sampled FROM n)"
SAMPLED = f"{PAGES}, sampled AS (SELECT spans.*, w.sampled FROM spans JOIN w USING (doc_id) WHERE page >= start AND page < start + w.sampled)"
LEARNED = f"""{SAMPLED}, hs AS (SELECT doc_id, {UP('size', 1)} AS size, sum(length(str)) AS chars, min(page * 10000000000 + seq) AS o FROM sampled GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(size, chars * 100000000000000::HUGEINT - o) AS b FROM hs GROUP BY doc_id),
hr AS (SELECT doc_id, page, {UP('y_base')} AS row, min(x0) AS x, arg_min(y_base, seq) AS y, string_agg(str, '' ORDER BY seq) AS text, any_value(sampled) AS sampled FROM sampled GROUP BY 1, 2, 3),
hx AS (SELECT doc_id, ({UP('x / 2')} * 2)::BIGINT AS x, count(*) AS n FROM hr GROUP BY 1, 2),
sh AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS share FROM hx),
lf AS (SELECT doc_id, coalesce(min(x) FILTER (share > 0.06), min(x)) AS body_x0, max(x) FILTER (share > 0.03 AND x <= 612 * 0.35) AS ind FROM sh GROUP BY doc_id),
learned AS (SELECT doc_id, b AS body_size, body_x0, coalesce(ind, body_x0) AS indent_max,
 {UP('b - 0.6::DOUBLE', 1)} AS body_lo, {UP('b + 0.8::DOUBLE', 1)} AS body_hi, {UP('b - 1.4::DOUBLE', 1)} AS abstract_lo, {UP('b - 0.7::DOUBLE', 1)} AS abstract_hi, {UP('b - 2.2::DOUBLE', 1)} AS note_lo, {UP('b - 1.5::DOUBLE', 1)} AS note_hi, {UP('b + 1.4::DOUBLE', 1)} AS head_min,
 {UP('coalesce(ind, body_x0) + b * 0.6::DOUBLE')}::DOUBLE AS body_x0_max, {UP('body_x0 + b * 8')}::DOUBLE AS abstract_x0_max, {UP('612 - body_x0 - 612 * 0.12::DOUBLE')}::DOUBLE AS body_x1_min FROM b JOIN lf USING (doc_id))"""


def profiled(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The learned layout and the running heads of each document."""
    pages = spans.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    some = profile.sampled(spans, pages)
    rows = profile.row_starts(some)
    counts = some.select("doc_id", "sampled").distinct()
    return profile.learned(profile.size_histogram(some), profile.x_histogram(rows)), profile.running_heads(profile.edge_texts(rows, TS.PAGE_HEIGHT), counts)


def profiled_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """profiled() of documents set as pages, in one pass over the documents."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            pages = ((d, list(TS.set_document(text, source))) for d, text, source in zip(frame["doc_id"], frame["text"], frame["source"]) if text is not None)
            out = [profile.said(d, p, TS.PAGE_HEIGHT) for d, p in pages if p]
            yield pd.DataFrame([x for x in out if x], columns=["doc_id", "sampled", "sizes", "rows"])

    sizes, rows, counts = profile.histograms(written(documents.select("doc_id", "text", "source").mapInPandas(run, profile.SAID), "said"))
    return profile.learned(sizes, profile.x_histogram(rows)), profile.running_heads(profile.edge_texts(rows, TS.PAGE_HEIGHT), counts.hint("merge"))


@query(f"{LEARNED} SELECT * FROM learned")
def layout_profile(spark, sf_dir):
    return profiled(written_spans(spark, sf_dir))[0]


HEADS = f", heads AS (SELECT doc_id, {P.EDGE_KEY('text')} AS edge_key FROM hr WHERE y < {H} * 0.09 OR y > {H} * 0.91 GROUP BY 1, 2 HAVING length(edge_key) >= 3 AND count(*) >= least(3, greatest(2, floor(any_value(sampled) / 3.0))))"


@query(f"{LEARNED}{HEADS} SELECT * FROM heads")
def running_heads(spark, sf_dir):
    return profiled(written_spans(spark, sf_dir))[1]


@query(f"""{LEARNED}{HEADS}{LINES} SELECT doc_id, page, y_base, text FROM lines l WHERE NOT (NOT (y_top > {H} * 0.09 AND y_bot < {H} * 0.91)
 AND EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = l.doc_id AND h.edge_key = {P.EDGE_KEY('l.text')}))""")
def body_lines(spark, sf_dir):
    """Lines without running heads: an anti-join on the document and the line's key, for lines in the margin bands."""
    spans = written_spans(spark, sf_dir)
    found = lines_of(spans)
    inner = (F.col("y_top") > TS.PAGE_HEIGHT * 0.09) & (F.col("y_bot") < TS.PAGE_HEIGHT * 0.91)
    key = F.when(~inner, T.edge_key("text"))
    return found.withColumn("edge_key", key).join(profiled(spans)[1], ["doc_id", "edge_key"], "left_anti").select("doc_id", "page", "y_base", "text")


@query("""SELECT doc_id, arg_max(font, w * 100000000000000::HUGEINT - o) AS font FROM (SELECT doc_id, font, sum(greatest(length(str), 1)) AS w, min(page * 10000000000 + seq) AS o FROM spans GROUP BY 1, 2) GROUP BY doc_id""")
def dominant_font(spark, sf_dir):
    spans = spans_of(spark, sf_dir).withColumn("place", F.col("page") * F.lit(10_000_000_000) + F.col("seq"))
    return profile.dominant(spans, ["doc_id"], "font", F.greatest(F.length("str"), F.lit(1)), "place")


@query(f"""{LINES}, h AS (SELECT doc_id, {UP('size * 2')} / 2 AS size, sum(length(text)) AS w, min(page * 10000000 + y_base) AS o FROM lines GROUP BY 1, 2) SELECT doc_id, arg_max(size, w * 100000000000 - o) AS body_size FROM h GROUP BY doc_id""")
def body_size(spark, sf_dir):
    found = lines_of(spans_of(spark, sf_dir)).withColumns({"size": F.floor(F.col("size") * 2 + 0.5) / 2, "place": F.col("page") * F.lit(10_000_000) + F.col("y_base")})
    return profile.dominant(found, ["doc_id"], "size", F.length("text"), "place", "body_size")


#: Two-column pages: the right half of the rows is set 30 points to the right; in documents of even number five points lower, in the others level.
TWO_COLUMNS = """, halves AS (SELECT doc_id, page, seq, str, size, font, x0 >= 300 AS r, CASE WHEN x0 >= 300 THEN x0 + 30 ELSE x0 END AS x0,
 CASE WHEN x0 >= 300 THEN least(x1 + 30, 612) ELSE least(x1, 300) END AS x1, y_base + CASE WHEN x0 >= 300 AND doc_id % 2 = 0 THEN 5 ELSE 0 END AS y_base FROM spans WHERE y_base > 40)"""


def two_columns(spans: DataFrame) -> DataFrame:
    right = F.col("x0") >= 300
    return spans.filter("y_base > 40").select(  # running heads stay out of the columns
        "doc_id", "page", "seq", "str", "size", "font", F.when(right, F.col("x0") + 30).otherwise(F.col("x0")).alias("x0"),
        F.when(right, F.least(F.col("x1") + 30, F.lit(612.0))).otherwise(F.least("x1", F.lit(300.0))).alias("x1"),
        (F.col("y_base") + F.when(right & (F.col("doc_id") % 2 == 0), 5).otherwise(0)).alias("y_base"),
    )


@query(f"""{TWO_COLUMNS}, c AS (SELECT doc_id, page, unnest(range(floor(x0)::BIGINT, ceil(x1)::BIGINT + 1)) AS x FROM halves), u AS (SELECT DISTINCT doc_id, page, x FROM c),
g AS (SELECT doc_id, page, x, lead(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS nx FROM u)
SELECT doc_id, page, max(nx - x - 1) AS gap, arg_max((x + 1 + nx) / 2.0, (nx - x - 1) * 10000 - x) AS centre FROM g WHERE nx - x - 1 >= 6 AND x + 1 > 612 * 0.25 AND nx < 612 * 0.75 GROUP BY doc_id, page""")
def column_coverage(spark, sf_dir):
    """The widest run of x that no span covers, in the middle half of the page: gaps between covered points."""
    covered = two_columns(spans_of(spark, sf_dir)).select("doc_id", "page", F.explode(F.sequence(F.floor("x0"), F.ceil("x1"))).alias("x")).distinct()
    after = F.lead("x").over(Window.partitionBy("doc_id", "page").orderBy("x"))
    gaps = covered.withColumn("nx", after).withColumn("w", F.col("nx") - F.col("x") - 1)
    fit = gaps.filter((F.col("w") >= 6) & (F.col("x") + 1 > 612 * 0.25) & (F.col("nx") < 612 * 0.75))
    return fit.groupBy("doc_id", "page").agg(F.max("w").alias("gap"), F.max_by((F.col("x") + 1 + F.col("nx")) / 2, F.struct("w", F.negative("x"))).alias("centre"))


@query(f"""{TWO_COLUMNS}, b AS (SELECT DISTINCT doc_id, page, r, {UP('y_base * 2')} / 2 AS y FROM halves),
m AS (SELECT l.doc_id, l.page, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM b q WHERE q.r AND q.doc_id = l.doc_id AND q.page = l.page AND abs(q.y - l.y) <= 0.5)) AS met FROM b l WHERE NOT l.r GROUP BY 1, 2)
SELECT doc_id, page, n AS n_left, met::DOUBLE / n AS aligned, n >= 6 AND met::DOUBLE / n <= 0.35 AS columns FROM m""")
def baseline_alignment(spark, sf_dir):
    """The share of left baselines that a right one meets within half a point: a semi-join on half-point keys."""
    halves = two_columns(spans_of(spark, sf_dir)).select("doc_id", "page", (F.col("x0") >= 330).alias("r"), F.floor(F.col("y_base") * 2 + 0.5).cast("long").alias("y2")).distinct()
    right = halves.filter("r").select("doc_id", "page", F.explode(F.array(F.col("y2") - 1, F.col("y2"), F.col("y2") + 1)).alias("y2")).distinct().withColumn("met", F.lit(1))
    left = halves.filter("not r").join(right, ["doc_id", "page", "y2"], "left").groupBy("doc_id", "page").agg(F.count("*").alias("n_left"), (F.count("met") / F.count("*")).alias("aligned"))
    return left.select("doc_id", "page", "n_left", "aligned", ((F.col("n_left") >= 6) & (F.col("aligned") <= 0.35)).alias("columns"))


def line_blocks(spans: DataFrame) -> DataFrame:
    """Each line as a block of its own, with what the rules of kind() ask for."""
    return lines_of(spans).withColumns({"n_lines": F.lit(1), "left_spread": F.lit(0.0), "wide_share": F.lit(0.0)})


def columns(df: DataFrame, names) -> dict:
    return {n: F.col(n) for n in names}


BLOCK = ("text", "size", "font", "x0", "x1", "y_top", "y_bot", "n_lines", "left_spread", "wide_share")
LAYOUT = ("body_lo", "body_hi", "abstract_lo", "abstract_hi", "note_lo", "note_hi", "head_min", "body_x0_max", "body_x1_min", "abstract_x0_max")
WORDS = f"len(regexp_split_to_array(text, '{X.WS}+'))"
BOLD, FULL = f"regexp_matches(font, '{X.BOLD}')", "(x0 < body_x0_max AND x1 > body_x1_min)"
ODD = f"(({P.IS_MATH('text')}) OR ({P.IS_TABULAR('text')}))"
KIND = f"""CASE WHEN text = '' THEN NULL WHEN y_top > {H} * 0.88 AND regexp_matches(text, '{X.PAGE_NUMBER}') AND length(text) <= 5 THEN NULL
 WHEN regexp_matches(text, '\\.{{4,}}') AND regexp_matches(text, '[0-9]') THEN 'ref' WHEN regexp_matches(text, '{X.CAPTION}') THEN 'caption'
 WHEN {BOLD} AND size >= head_min THEN 'heading' WHEN {BOLD} AND size >= body_lo AND regexp_matches(text, '{X.NUMBERED}') AND {WORDS} <= 14 THEN 'heading'
 WHEN size >= head_min AND x0 < body_x0_max + 175 AND length(text) < 90 THEN 'heading' WHEN {BOLD} AND NOT {FULL} AND length(text) < 30 AND regexp_matches(text, '{X.SHORT_TITLE}') THEN 'heading'
 WHEN (size BETWEEN body_lo AND body_hi OR size BETWEEN abstract_lo AND abstract_hi) AND NOT {ODD} AND ({FULL} OR (x0 < body_x0_max AND {WORDS} >= 4)) THEN 'para'
 WHEN {FULL} AND size BETWEEN note_lo AND note_hi THEN 'note'
 WHEN x1 - x0 > greatest(120, body_x1_min - body_x0_max) * 0.85 AND size BETWEEN note_lo - 0.8 AND body_hi + 0.8 AND NOT {ODD} AND {P.LOOKS_PROSE('text')} THEN CASE WHEN size > note_hi THEN 'para' ELSE 'note' END
 ELSE 'graphic' END"""


def kinds_of_lines(spark, sf_dir) -> DataFrame:
    spans = written_spans(spark, sf_dir)
    blocks = line_blocks(spans).join(profiled(spans)[0], "doc_id")
    layout = columns(blocks, LAYOUT) | {"abstract_min_w": F.lit(350.0)}
    return blocks.withColumn("kind", classify.kind(columns(blocks, BLOCK), layout, F.lit(TS.PAGE_HEIGHT)))


@query(f"{LEARNED}{LINES}, k AS (SELECT doc_id, page, y_base, {KIND} AS kind FROM lines JOIN learned USING (doc_id)) SELECT * FROM k")
def line_kinds(spark, sf_dir):
    return kinds_of_lines(spark, sf_dir).select("doc_id", "page", "y_base", "kind")


@query(f"{LEARNED}{LINES}, k AS (SELECT doc_id, length(text) AS n, {KIND} AS kind FROM lines JOIN learned USING (doc_id)) SELECT doc_id, kind, count(*) AS blocks, sum(CASE WHEN kind IN {P.listed(X.TRANSLATED_KINDS)} THEN n ELSE 0 END)::BIGINT AS translated_chars FROM k GROUP BY doc_id, kind")
def kind_histogram(spark, sf_dir):
    translated = F.col("kind").isin(*X.TRANSLATED_KINDS)
    return kinds_of_lines(spark, sf_dir).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.when(translated, F.length("text")).otherwise(0)).alias("translated_chars"))


@query(f"""{LINES} SELECT doc_id, page, y_base, length(text) <= 60 AND x1 - x0 < 612 * 0.6 AND (y_top < {H} * 0.09 OR y_bot > {H} * 0.91) AS margin_label,
 (x1 - x0 > 612 * 0.7 AND (y_bot < {H} * 0.10 OR y_top > {H} * 0.90)) OR (y_bot - y_top < 6 AND x1 - x0 > 612 * 0.6) AS banner FROM lines""")
def margin_labels(spark, sf_dir):
    blocks = line_blocks(spans_of(spark, sf_dir))
    w, h = F.lit(TS.PAGE_WIDTH), F.lit(TS.PAGE_HEIGHT)
    return blocks.select("doc_id", "page", "y_base", classify.margin_label(columns(blocks, BLOCK), w, h).alias("margin_label"), classify.banner(F.col("x0"), F.col("y_top"), F.col("x1"), F.col("y_bot"), w, h).alias("banner"))
