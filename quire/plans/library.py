"""Queries over blocks made of documents' lines by a fixed rule: library, translation, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T
from quire.operators import blocks as BK
from quire.operators import library as L
from quire.operators import neighbours, streams
from quire.operators import translate as TR
from quire.plans import text as P
from quire.sources import docjson, html, script

QUERIES = {}
ORACLES = {}

BLOCKS = f"""bk0 AS (SELECT doc_id, line_no::BIGINT AS block_id, line AS t, (doc_id + line_no) % 7 AS m FROM {P.LINES}),
bk AS (SELECT doc_id, block_id, CASE m WHEN 0 THEN 'heading' WHEN 3 THEN 'caption' WHEN 5 THEN 'graphic' ELSE 'para' END AS kind, CASE WHEN m = 5 THEN '' ELSE t END AS text,
 CASE WHEN block_id % 4 = 1 AND m <> 5 THEN 'ZH ' || t END AS zh, (block_id // 10)::INT AS page, (12 + (doc_id + block_id) % 9)::DOUBLE AS size FROM bk0)"""


def query(sql: str | None, blocks: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {BLOCKS} {sql}" if blocks else sql
        return f

    return add


def blocks_of(spark, sf_dir) -> DataFrame:
    lines = P.lines(spark, sf_dir)
    m = (F.col("doc_id") + F.col("line_no")) % 7
    kind = F.when(m == 0, "heading").when(m == 3, "caption").when(m == 5, "graphic").otherwise("para")
    return lines.select(
        "doc_id", F.col("line_no").cast("long").alias("block_id"), kind.alias("kind"), F.when(m == 5, "").otherwise(F.col("line")).alias("text"),
        F.when((F.col("line_no") % 4 == 1) & (m != 5), F.concat(F.lit("ZH "), "line")).alias("zh"), F.floor(F.col("line_no") / 10).cast("int").alias("page"), (12 + (F.col("doc_id") + F.col("line_no")) % 9).cast("double").alias("size"),
    )


def cache_of(blocks: DataFrame) -> DataFrame:
    """A cache of every third document's texts."""
    key = T.cache_key(F.lit("m"), "text")
    return blocks.filter("doc_id % 3 = 0 and text <> ''").groupBy(key.alias("k")).agg(F.min(F.concat(F.lit("C "), "text")).alias("zh"))


@query("""SELECT doc_id, count(*) AS blocks, count(*) FILTER (zh IS NULL AND text <> '' AND text IN (SELECT text FROM bk WHERE doc_id % 3 = 0)) AS hits FROM bk GROUP BY doc_id""")
def cache_hits(spark, sf_dir):
    blocks = blocks_of(spark, sf_dir)
    found = TR.looked_up(blocks.withColumn("had", F.col("zh").isNotNull()), cache_of(blocks), "m")
    return found.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(~F.col("had") & F.col("zh").isNotNull()).alias("hits"))


BLANK = f"{P.TRIM('text')} <> ''"


@query(f"SELECT doc_id, count(*) FILTER (kind IN {P.listed(X.TRANSLATED_KINDS)} AND {BLANK} AND coalesce(zh, '') = '') AS pending, count(*) FILTER (coalesce(zh, '') <> '') AS translated, count(*) AS blocks FROM bk GROUP BY doc_id")
def pending_counts(spark, sf_dir):
    return L.pending_counts(blocks_of(spark, sf_dir))


@query("""SELECT d.doc_id AS id, d.source AS title, d.n_chars AS created, count(*) AS n_blocks, count(*) FILTER (coalesce(zh, '') <> '') AS n_translated FROM documents d JOIN bk USING (doc_id) GROUP BY 1, 2, 3""")
def doc_listing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("n_chars").alias("created"))
    return L.listing(docs, blocks_of(spark, sf_dir))


@query("""SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS place, batch FROM (
WITH RECURSIVE o AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT source, doc_id, r, n AS used, 0 AS batch FROM o WHERE r = 1 UNION ALL
 SELECT o.source, o.doc_id, o.r, CASE WHEN p.used > 0 AND p.used + o.n > 2200 THEN o.n ELSE p.used + o.n END, CASE WHEN p.used > 0 AND p.used + o.n > 2200 THEN p.batch + 1 ELSE p.batch END FROM p JOIN o ON o.source = p.source AND o.r = p.r + 1)
SELECT * FROM p)""", blocks=False)
def translation_batches(spark, sf_dir):
    docs = P.documents(spark, sf_dir)
    found = TR.packed(docs.select("source", "doc_id", "text"), ["source"], "doc_id", 2200)
    place = neighbours.placed(docs, "source", "doc_id").withColumnRenamed("source", "_source")
    return found.join(place, "doc_id").select("source", "doc_id", "place", "batch")


GLOSSARY = "[" + ", ".join(f"{{'k': {P.quoted(k.lower())}, 't': {P.quoted(f'{k} → {v}')}}}" for k, v in X.GLOSSARY.items()) + "]"


@query(f"SELECT doc_id, list_transform(list_slice(list_filter({GLOSSARY}, lambda g: contains(lower(text || ' The utility of turnover: KKT conditions, drawdown'), g.k)), 1, 40), lambda g: g.t) AS terms FROM documents", blocks=False)
def glossary_hits(spark, sf_dir):
    return TR.glossary_hits(P.documents(spark, sf_dir), ["doc_id"], F.concat("text", F.lit(" The utility of turnover: KKT conditions, drawdown")))


@query(f"""WITH t AS (SELECT doc_id, list_transform(list_slice(list_filter({GLOSSARY}, lambda g: contains(lower(text || CASE WHEN doc_id % 2 = 0 THEN ' turnover, drawdown' ELSE '' END), g.k)), 1, 40), lambda g: g.t) AS terms FROM documents)
SELECT doc_id, {P.quoted(TR.RULES.replace("{language}", "French"))} || CASE WHEN len(terms) > 0 THEN {P.quoted(TR.TERMS.strip())} || chr(10) || array_to_string(terms, '；') ELSE '' END AS system FROM t""".replace("THEN 'Use these", "THEN chr(10) || 'Use these"), blocks=False)
def system_prompts(spark, sf_dir):
    """What a model is told for each document as a batch; every other one has terms in it."""
    texts = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " turnover, drawdown").otherwise(""))
    found = TR.glossary_hits(P.documents(spark, sf_dir), ["doc_id"], texts)
    return found.select("doc_id", TR.system_prompt("French", "terms").alias("system"))


@query(f"""SELECT doc_id, block_id, CASE WHEN zh IS NOT NULL THEN zh WHEN kind IN {P.listed(X.TRANSLATED_KINDS)} AND {BLANK} THEN replace({P.TRIM('text')}, 'e', 'E') END AS zh, NULL::VARCHAR AS err FROM bk""")
def translated(spark, sf_dir):
    """The whole flow, with an offline client."""
    blocks = blocks_of(spark, sf_dir).drop("size", "page")
    none = spark.createDataFrame([], "k string, zh string")
    out, _ = TR.translate(blocks, none, TR.offline_client, TR.Settings(pause=0.0))
    return out.select("doc_id", "block_id", "zh", "err")


MARKS = """hm AS (SELECT event_id AS id, user_id % 100 AS doc_id, (event_id % 5)::BIGINT AS block_id, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'zh' END AS field, (event_id % 50)::INT AS start, (event_id % 50 + 5 + event_id % 7)::INT AS "end" FROM events)"""


def marks_of(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = (F.col("event_id") % 50).cast("int")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 100).alias("doc_id"), (F.col("event_id") % 5).alias("block_id"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("zh").alias("field"), start.alias("start"), (start + 5 + F.col("event_id") % 7).cast("int").alias("end"))


@query(f""", {MARKS}, pl AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) - 1 AS p FROM bk)
SELECT id, doc_id, block_id, coalesce(p, 0)::INT AS block_place, (row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(p, 0), start, id) - 1)::INT AS note FROM hm LEFT JOIN pl USING (doc_id, block_id)""")
def notes_order(spark, sf_dir):
    return L.notes(marks_of(spark, sf_dir), blocks_of(spark, sf_dir)).select("id", "doc_id", "block_id", "block_place", "note")


@query(f""", {MARKS} SELECT id FROM hm h WHERE NOT EXISTS (SELECT 1 FROM hm e WHERE e.id % 100 = 0 AND e.doc_id = h.doc_id AND e.block_id = h.block_id AND e.field = h.field AND h.start < e."end" AND h."end" > e.start)""")
def erased_highlights(spark, sf_dir):
    marks = marks_of(spark, sf_dir)
    return L.without_overlapping(marks, marks.filter("id % 100 = 0")).select("id")


@query(f""", {MARKS}, mk AS (SELECT DISTINCT doc_id, block_id, start, "end" FROM hm WHERE field = 'en'), o AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY doc_id, block_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM mk),
g AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, block_id ORDER BY start, "end") AS g FROM o), m AS (SELECT doc_id, block_id, min(start) AS a, max("end") AS b FROM g GROUP BY doc_id, block_id, g)
SELECT doc_id, block_id, sum(least(b, length(text)) - least(a, length(text)))::BIGINT AS marked_chars, count(*) AS pieces FROM m JOIN bk USING (doc_id, block_id) GROUP BY 1, 2""")
def painted_text(spark, sf_dir):
    from quire.operators.intervals import islands

    marks = marks_of(spark, sf_dir).filter("field = 'en'").select("doc_id", "block_id", "start", "end").distinct()
    merged = islands(marks, ["doc_id", "block_id"], "start", "end").groupBy("doc_id", "block_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    painted = L.painted(blocks_of(spark, sf_dir).select("doc_id", "block_id", "text"), merged, ["doc_id", "block_id"])
    return painted.filter("marked").groupBy("doc_id", "block_id").agg(F.sum(F.length("source")).alias("marked_chars"), F.count("*").alias("pieces"))


@query("SELECT doc_id, count(*) AS segments, sum(length(t))::BIGINT AS chars, max(o) AS last_at FROM (SELECT doc_id, t, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)) GROUP BY doc_id", blocks=False)
def source_offsets(spark, sf_dir):
    segments = P.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("k", "source"))
    return L.source_offset(segments, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.length("source")).alias("chars"), F.max("at").alias("last_at"))


@query("""SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || CASE WHEN role = 'user' AND f = 1 THEN 'CTX ' || conv_id || chr(10) || chr(10) || text ELSE text END, chr(10) ORDER BY turn)) AS wire_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS f FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY conv_id""", blocks=False)
def conversation_wire(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    context = turns.select("conv_id").distinct().withColumn("context", F.concat(F.lit("CTX "), F.col("conv_id").cast("string")))
    sent = L.wire(turns, context)
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return sent.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(joined, 256).alias("wire_sha256"))


@query("SELECT conv_id * 1000 + turn AS conv_id, text FROM conversations", blocks=False)
def sse_reassembly(spark, sf_dir):
    """Each turn's text sent in chunks that are cut anywhere, and put together again."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), "text")
    return streams.reassembled(streams.chunked(turns))


#: A page's elements by cutting it before every block's tag: right where blocks don't stand within text elements and no image without one has a text, as in the tables.
BLOCK_TAGS = "h[1-6]|p|li|figcaption|img|td|table|thead|tbody|tfoot|tr|th|caption|html|head|body|title|div|article|section|main|nav|aside|header|footer|figure|blockquote|pre|address|ul|ol|menu|dl|dt|dd|form|fieldset|details|summary"
ELEMENTS = f"""(WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '{html.NOISE}', '', 'g'), '(?i)<[bh]r\\b[^>]*>', ' ', 'g'), '(?i)<(/?(?:{BLOCK_TAGS}))\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g') AS h FROM pages),
d AS (SELECT page_id, regexp_replace(h, '(?i)</?[a-z][a-z0-9_]*\\b[^>]*>|<[!?][^>]*>', '', 'g') AS h FROM c),
e AS (SELECT page_id, unnest(string_split(h, chr(1))) AS part, generate_subscripts(string_split(h, chr(1)), 1) AS i FROM d)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS seq, lower(string_split(part, chr(2))[1]) AS tag, CASE WHEN lower(string_split(part, chr(2))[1]) = 'img' THEN '' ELSE {P.COLLAPSE('string_split(part, chr(2))[2]')} END AS text FROM e
WHERE i > 1 AND regexp_matches(part, '(?i)^(h[1-6]|p|li|figcaption|img|td)' || chr(2)))"""
KIND = "CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'img' THEN 'graphic' WHEN tag = 'figcaption' THEN 'caption' ELSE 'para' END"


@query(f"SELECT page_id, seq, tag, {KIND} AS kind, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2, 1)::INT END AS level, text FROM {ELEMENTS}", blocks=False)
def html_blocks(spark, sf_dir):
    return html.blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(f"SELECT {KIND} AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM {ELEMENTS} GROUP BY 1", blocks=False)
def html_kinds(spark, sf_dir):
    return html.blocks(spark.read.parquet(f"{sf_dir}/pages.parquet")).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH c AS (SELECT page_id, regexp_replace(html, '{html.NOISE}', '', 'g') AS h FROM pages), n AS (SELECT page_id, len(regexp_extract_all(h, '(?i)<(?:h[1-6]|p|li|td)\\b'))::INT AS texts, len(regexp_extract_all(h, '(?i)<(?:svg|path|rect|line|div|span)\\b'))::INT AS drawn, len(regexp_extract_all(h, '(?i)<img\\b'))::INT AS images FROM c)
SELECT *, images > 0 OR drawn > 40 AS likely_figures FROM n""", blocks=False)
def page_census(spark, sf_dir):
    return html.census(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def scripts_of(spark, sf_dir) -> DataFrame:
    """Each document as a script: a title, its lines as tagged blocks with translations, and a figure."""
    d = P.documents(spark, sf_dir)
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, "^@+", "")), lambda x: T.trim(x) != "")
    tags = F.array(*map(F.lit, ["h1", "p", "note", "cap", "ref"]))
    body = F.transform(lines, lambda x, i: F.concat(F.lit("@"), tags[i % 5], F.lit("\n"), T.trim(x), F.when(i % 2 == 0, F.concat(F.lit("\n--\nZ "), F.col("doc_id").cast("string"))).otherwise("")))
    head = F.concat(F.lit("@meta\ntitle-en: T "), F.col("doc_id").cast("string"), F.lit("\nfile: f.pdf\n@page 2\n"))
    return d.select("doc_id", F.concat(head, F.array_join(body, "\n"), F.lit("\n@page 3\n@fig 1, 2.5 30 40\n")).alias("text"))


SCRIPT_LINES = f"""sl0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^@+', '')), lambda x: {P.TRIM('x')} <> '') AS a FROM documents),
sl AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS i, len(a) AS n FROM sl0)"""


@query(f"""WITH {SCRIPT_LINES} SELECT doc_id, i::BIGINT AS block_id, ['heading', 'para', 'note', 'caption', 'ref'][(i % 5 + 1)::INT] AS kind, CASE WHEN i % 5 = 0 THEN 1 END::INT AS level, 2 AS page, {P.TRIM('t')} AS text,
 CASE WHEN i % 2 = 0 THEN 'Z ' || doc_id ELSE '' END AS zh, NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1 FROM sl
 UNION ALL SELECT doc_id, len(a)::BIGINT, 'graphic', NULL, 3, '', NULL, 1.0, 2.5, 30.0, 40.0 FROM sl0""", blocks=False)
def script_blocks(spark, sf_dir):
    return script.blocks(script.tagged_lines(scripts_of(spark, sf_dir)))


@query("SELECT doc_id, 'title-en' AS key, 'T ' || doc_id AS value FROM documents UNION ALL SELECT doc_id, 'file', 'f.pdf' FROM documents", blocks=False)
def script_meta(spark, sf_dir):
    return script.meta(script.tagged_lines(scripts_of(spark, sf_dir)))


@query("SELECT doc_id, 1 AS line_no, 'text outside of a block' AS fault FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 3, 'unknown tag' FROM documents UNION ALL SELECT doc_id, 4, 'figure needs four coordinates' FROM documents", blocks=False)
def script_faults(spark, sf_dir):
    rows = P.documents(spark, sf_dir).select("doc_id", F.concat(F.lit("@page 1\n"), F.when(F.col("doc_id") % 3 == 0, "stray").otherwise(""), F.lit("\n@p\n@what\n@fig 1 2 3")).alias("text"))
    return script.faults(script.tagged_lines(rows))


@query(f"""WITH {SCRIPT_LINES} SELECT doc_id, 3 AS pages, 'T ' || doc_id AS title, 'f.pdf' AS file_name, (count(*) + 1)::BIGINT AS n_blocks, (count(*) FILTER (i % 2 = 0))::BIGINT AS n_translated FROM sl GROUP BY doc_id""", blocks=False)
def built_and_imported(spark, sf_dir):
    """Scripts built into documents, and these imported."""
    lines = script.tagged_lines(scripts_of(spark, sf_dir))
    built = script.document(script.blocks(lines), script.meta(lines), 0)
    parsed = docjson.parse(built.withColumn("name", F.lit("x.json")))
    counts = docjson.blocks(parsed).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_blocks"), F.count_if(F.coalesce("zh", F.lit("")) != "").alias("n_translated"))
    rows = docjson.docs(parsed, 0).join(counts, "id").filter("n_blocks > 1")
    return rows.select(F.col("id").alias("doc_id"), "pages", "title", "file_name", "n_blocks", "n_translated")


SHOWN = "coalesce(zh, text)"


@query(f"SELECT doc_id, block_id, {SHOWN} AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, block_id) AS r FROM bk WHERE kind = 'heading' AND page <= 1) WHERE r = 1")
def doc_title(spark, sf_dir):
    return BK.title(blocks_of(spark, sf_dir))


LEVEL = "CASE WHEN size >= 19 THEN 1 WHEN size >= 16.5 THEN 2 WHEN size >= 13.5 THEN 3 ELSE 4 END"
CUT = f"regexp_replace(substr(regexp_replace({P.TRIM(SHOWN)}, '[^A-Za-z0-9_\\x{{4E00}}-\\x{{9FFF}}.]+', '-', 'g'), 1, 36), '^-|-\\z', '', 'g')"


@query(f""", ti AS (SELECT doc_id, block_id AS tid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, block_id) AS r FROM bk WHERE kind = 'heading' AND page <= 1) WHERE r = 1)
SELECT doc_id, block_id, {LEVEL} AS level, CASE WHEN {CUT} = '' THEN 's' || block_id ELSE 's' || block_id || '-' || {CUT} END AS anchor, {SHOWN} AS text FROM bk LEFT JOIN ti USING (doc_id) WHERE kind = 'heading' AND NOT coalesce(block_id = tid AND {LEVEL} = 1, false)""")
def toc(spark, sf_dir):
    blocks = blocks_of(spark, sf_dir)
    named = BK.contents(blocks.withColumn("zh", F.col("zh")))
    return named


@query(f"SELECT doc_id, block_id, coalesce(last_value(CASE WHEN kind = 'heading' THEN {SHOWN} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_id), '') AS section FROM bk")
def section_of(spark, sf_dir):
    return BK.sections(blocks_of(spark, sf_dir)).select("doc_id", "block_id", "section")


@query(f""", n AS (SELECT q.doc_id, q.block_id AS about, b.block_id, abs(b.block_id - q.block_id) AS far, CASE WHEN coalesce(b.zh, '') <> '' THEN b.zh || chr(10) || '（原文：' || b.text || '）' ELSE b.text END AS s
 FROM bk q JOIN bk b ON b.doc_id = q.doc_id AND b.block_id BETWEEN q.block_id - 9 AND q.block_id + 9 WHERE q.kind = 'graphic' AND b.kind IN {P.listed(X.TRANSLATED_KINDS)} AND b.text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, about ORDER BY far, block_id) AS r FROM n) SELECT doc_id, about AS block_id, sha256(string_agg(s, chr(10) || chr(10) ORDER BY r)) AS context_sha256 FROM r WHERE r <= 6 GROUP BY 1, 2""")
def context_window(spark, sf_dir):
    blocks = blocks_of(spark, sf_dir)
    found = BK.context(blocks, blocks.filter("kind = 'graphic'").select("doc_id", "block_id"))
    return found.select("doc_id", "block_id", F.sha2("context", 256).alias("context_sha256"))


#: Blocks with a reference section from the fifth block on that ends at the next heading of at least 17 points.
REFERENCES = """, rf AS (SELECT doc_id, block_id, CASE WHEN block_id = 4 THEN 'heading' ELSE kind END AS kind, CASE WHEN block_id = 4 THEN 'References*' ELSE text END AS text, CASE WHEN block_id = 4 THEN 15.0::DOUBLE ELSE size END AS size FROM bk)"""


@query(f"""{REFERENCES}, e AS (SELECT doc_id, coalesce(min(block_id) FILTER (block_id > 4 AND kind = 'heading' AND size >= 17), 1000000) AS e, max(block_id) >= 4 AS has FROM rf GROUP BY doc_id)
SELECT doc_id, block_id, CASE WHEN has AND block_id > 4 AND block_id < e AND kind IN ('para', 'note') THEN 'ref' ELSE kind END AS kind FROM rf JOIN e USING (doc_id) WHERE NOT (has AND block_id > 4 AND block_id < e AND kind = 'graphic')""")
def reference_section(spark, sf_dir):
    at = F.col("block_id") == 4
    rows = blocks_of(spark, sf_dir).withColumns({"kind": F.when(at, "heading").otherwise(F.col("kind")), "text": F.when(at, "References*").otherwise(F.col("text")), "size": F.when(at, 15.0).otherwise(F.col("size"))})
    return BK.references(rows).select("doc_id", "block_id", "kind")


@query(f"""{REFERENCES.replace("'References*'", "'Bibliography of'")}, e AS (SELECT doc_id, coalesce(min(block_id) FILTER (block_id > 4 AND kind = 'heading' AND size >= 14.6::DOUBLE), 1000000) AS e, max(block_id) >= 4 AS has FROM rf GROUP BY doc_id)
SELECT doc_id, block_id, CASE WHEN has AND block_id > 4 AND block_id < e AND kind IN ('para', 'note') THEN 'ref' ELSE kind END AS kind FROM rf JOIN e USING (doc_id)""")
def model_references(spark, sf_dir):
    """The same by a model's rules: more words open the section, a heading of nearly the opening one's size ends it, and graphics stay."""
    at = F.col("block_id") == 4
    rows = blocks_of(spark, sf_dir).withColumns({"kind": F.when(at, "heading").otherwise(F.col("kind")), "text": F.when(at, "Bibliography of").otherwise(F.col("text")), "size": F.when(at, 15.0).otherwise(F.col("size"))})
    return BK.references(rows, model=True).select("doc_id", "block_id", "kind")


@query(f"""SELECT doc_id, block_id, CASE WHEN r <= 8 AND kind = 'heading' AND {P.COUNT('text', ',')} >= 3 THEN 'ref' ELSE kind END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS r FROM bk)""")
def byline_kinds(spark, sf_dir):
    return BK.bylines(blocks_of(spark, sf_dir)).select("doc_id", "block_id", "kind")


@query("""SELECT doc_id, regexp_replace(arg_min(z, line_no), '\\*+\\z', '') AS title FROM (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN ' ' WHEN line_no % 3 = 1 THEN 'Z ' || line || '**' END AS z FROM """ + P.LINES + """) WHERE trim(coalesce(z, '')) <> '' GROUP BY doc_id""", blocks=False)
def translated_titles(spark, sf_dir):
    """Every line as a heading; some have no translation, a blank one, or one that ends in asterisks."""
    zh = F.when(F.col("line_no") % 3 == 0, " ").when(F.col("line_no") % 3 == 1, F.concat(F.lit("Z "), "line", F.lit("**")))
    rows = P.lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("block_id"), F.lit("heading").alias("kind"), zh.alias("zh"))
    return L.translated_titles(rows)


@query("""SELECT source, doc_id, place::INT AS place, more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, greatest(0, count(*) OVER (PARTITION BY source) - 6) AS more FROM documents) WHERE place <= 6""", blocks=False)
def first_and_more(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "n_chars")
    return L.first_of(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", "place", "more")


@query("SELECT event_id, 'd' || lower(to_base(epoch_us(ts) // 1000, 36)) || substr(md5(event_id::VARCHAR), 1, 5) AS id FROM events", blocks=False)
def new_ids(spark, sf_dir):
    """Ids made of each event's time and number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", L.new_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id")).alias("id"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS saves FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, g""", blocks=False)
def debounced_saves(spark, sf_dir):
    """A user's events as saves, of which those within ten minutes of the next are put together."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    found = L.debounced(e, ["user_id"], "ts", "10 minutes")
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "saves")


@query("""SELECT item_id AS doc_id, octet_length(encode(text || ' (2)'))::INT AS n_bytes, sha256(text || ' (2)') AS content_sha256, 'Passage ' || item_id AS title FROM benchmark WHERE item_id <> (SELECT min(item_id) FROM benchmark)""", blocks=False)
def library_round_trip(spark, sf_dir):
    """Passages as files of a library: put, put again with other contents, one dropped, and read back with their documents."""
    from quire.sources.tables import new_path

    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("doc_id"), "text")
    lib = L.Library(spark, new_path(spark, "library")).open()
    none = {n: lib.table(n).limit(0) for n in ("docs", "files")}
    lib.put("docs", none["docs"].unionByName(rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("Passage "), F.col("doc_id").cast("string")).alias("title")), allowMissingColumns=True))
    for mark in ("", " (2)"):
        lib.put("files", none["files"].unionByName(rows.select("doc_id", F.encode(F.concat("text", F.lit(mark)), "UTF-8").alias("content"))))
    lib.drop(rows.agg(F.min("doc_id")).first()[0])
    files = lib.table("files").select("doc_id", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"))
    return files.join(lib.table("docs").select(F.col("id").alias("doc_id"), "title"), "doc_id")
