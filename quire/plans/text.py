"""Queries over texts: predicates, statistics, markup and protocol functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed as X
from quire.functions import text as T
from quire.sources.tables import written

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


WS = X.WS
TRIM = lambda e: f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"
COLLAPSE = lambda e: f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'), ' ')"
CHARS = lambda e, c: f"(length({e}) - length(translate({e}, {quoted(c)}, '')))"
COUNT = lambda e, p: f"len(regexp_extract_all({e}, {quoted(p)}))"
NORM = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"
LATIN = lambda e: f"regexp_extract_all(lower({e}), {quoted(X.WORD)})"
STOPS = lambda e, w: f"len(list_filter({LATIN(e)}, lambda w: w IN {listed(w)}))"
IS_MATH = lambda e: (
    f"CASE WHEN length({e}) = 0 THEN false"
    f" WHEN regexp_matches({e}, '{X.SENTENCE}') AND {CHARS(e, X.MATH)}::DOUBLE / length({e}) < 0.12 THEN false"
    f" WHEN length({e}) < 90 AND regexp_matches({e}, '(?i)\\b(arg{WS}*min|arg{WS}*max|s\\.t\\.|subject to)\\b') THEN true"
    f" ELSE {CHARS(e, X.MATH)}::DOUBLE / length({e}) > 0.04 END"
)
PACKED = lambda e: f"replace({e}, ' ', '')"
PIECES = lambda e: f"list_transform(regexp_split_to_array({e}, '{WS}+'), lambda w: lower(regexp_replace(w, '^[.,()%:;]+|[.,()%:;]+\\z', '', 'g')))"
IS_TABULAR = lambda e: (
    f"CASE WHEN length({PACKED(e)}) >= 14 AND {COUNT(PACKED(e), '[0-9.]')}::DOUBLE / length({PACKED(e)}) > 0.32 THEN true"
    f" WHEN length({e}) >= 120 THEN false WHEN len({PIECES(e)}) < 4 THEN false"
    f" WHEN regexp_matches({e}, '[.!?:;]{WS}*\\z') THEN false"
    f" ELSE len(list_filter({PIECES(e)}, lambda w: w IN {listed(X.STOPWORDS)})) = 0 END"
)
LOOKS_PROSE = lambda e: f"(len({LATIN(e)}) >= 12 AND {STOPS(e, X.STOPWORDS)} >= 3 AND regexp_matches({e}, '[.!?]'))"
SOLID = lambda e: f"regexp_replace({e}, '{WS}', '', 'g')"


def METRICS(e: str) -> dict[str, str]:
    n = f"greatest(length({SOLID(e)}), 1)"
    return {
        "n_solid": n, "n_words": f"len({LATIN(e)})", "n_stops": STOPS(e, X.AUDIT_STOPWORDS),
        "letter": f"({COUNT(SOLID(e), '[A-Za-z]')}::DOUBLE / {n})", "digit": f"({COUNT(SOLID(e), '[0-9]')}::DOUBLE / {n})",
        "math": f"({CHARS(SOLID(e), X.SOFT_MATH)}::DOUBLE / {n})", "n_ends": COUNT(e, f"[.!?](?:{WS}|\\z)"),
    }


IS_PROSE = lambda e: (lambda m: f"({m['n_words']} >= 12 AND {m['letter']} > 0.6 AND {m['n_stops']} >= 3 AND {m['math']} < 0.05 AND {m['digit']} < 0.2)")(METRICS(e))
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def lines(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


@query(f"SELECT doc_id, line_no::INT AS line_no, {IS_MATH('line')} AS is_math FROM {LINES}")
def is_math(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.is_math("line").alias("is_math"))


@query(f"SELECT doc_id, line_no::INT AS line_no, {IS_TABULAR('line')} AS is_tabular FROM {LINES}")
def is_tabular(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.is_tabular("line").alias("is_tabular"))


@query(f"SELECT doc_id, {LOOKS_PROSE('text')} AS looks_prose FROM documents")
def looks_prose(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.looks_prose("text").alias("looks_prose"))


@query("SELECT doc_id, " + ", ".join(f"{v}::INT AS {k}" if k.startswith("n_") else f"{v} AS {k}" for k, v in METRICS("text").items()) + " FROM documents")
def text_metrics(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in T.metrics("text").items()])


@query(f"SELECT doc_id, {IS_PROSE('text')} AS is_prose FROM documents")
def is_prose(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.is_prose("text").alias("is_prose"))


@query(f"SELECT doc_id, {CHARS('text', X.HARD_MATH)}::INT AS hard_math FROM documents")
def hard_math_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.hard_math("text").alias("hard_math"))


@query(f"SELECT doc_id, sha256({NORM('text')}) AS norm_sha256, length({NORM('text')})::INT AS n FROM documents")
def norm_text(spark, sf_dir):
    n = T.norm("text")
    return documents(spark, sf_dir).select("doc_id", F.sha2(n, 256).alias("norm_sha256"), F.length(n).alias("n"))


EDGE_KEY = lambda e: f"substr({COLLAPSE(f'''regexp_replace({e}, '[0-9]+', '#', 'g')''')}, 1, 60)"


@query(f"SELECT {EDGE_KEY('line')} AS edge_key, count(*) AS n FROM {LINES} GROUP BY 1")
def hf_key(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(T.edge_key("line").alias("edge_key")).agg(F.count("*").alias("n"))


LINE_CLASSES = {"caption": X.CAPTION, "page_number": X.PAGE_NUMBER, "page_number_model": X.PAGE_NUMBER_MODEL, "numbered": X.NUMBERED, "numbered_model": X.NUMBERED_MODEL, "sentence": X.SENTENCE, "short_title": X.SHORT_TITLE, "continues": X.CONTINUES, "ended": X.ENDED}


@query("SELECT doc_id, " + ", ".join(f"count(*) FILTER (regexp_matches(line, {quoted(p)})) AS {k}" for k, p in LINE_CLASSES.items()) + f" FROM {LINES} GROUP BY doc_id")
def line_classes(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(*[F.count_if(F.col("line").rlike(p)).alias(k) for k, p in LINE_CLASSES.items()])


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM('x')}), lambda x: length(x) > 4) AS a FROM documents)
SELECT doc_id, len(a)::INT AS n_lines, len(a) >= 8 AND len(list_distinct(a))::DOUBLE / greatest(len(a), 1) < 0.4 AS runaway FROM l""")
def runaway_docs(spark, sf_dir):
    long = F.filter(F.transform(F.split("text", "\n", -1), T.trim), lambda x: F.length(x) > 4)
    return documents(spark, sf_dir).select("doc_id", F.size(long).alias("n_lines"), T.runaway("text").alias("runaway"))


PIPES = lambda e: f"(length({e}) - length(replace({e}, '|', '')))"


@query(f"""WITH l AS (SELECT doc_id, text, regexp_split_to_array(text, '[\\n\\r\\x{{2028}}\\x{{2029}}]') AS a FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(a, lambda x: {PIPES('x')} >= 2)) >= 2
  OR (len(list_filter(a, lambda x: {PIPES('x')} >= 2)) >= 1 AND len(list_filter(a, lambda x: {PIPES(f"regexp_replace(x, '^{WS}*{X.NOT_WS}', '')")} >= 2)) > 0) THEN 'table'
  WHEN regexp_matches(text, '{X.FORMULA}') THEN 'math' ELSE 'text' END AS shape FROM l""")
def shape_of(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.shape("text").alias("shape"))


#: Table markup made of a document's words, one row each three words, every seventh cell merged.
OTSL = """(SELECT doc_id, array_to_string(list_transform(string_split(text, ' '),
  lambda w, i: CASE WHEN i % 7 = 0 THEN '<lcel>' ELSE '<fcel>' END || w || CASE WHEN i % 3 = 0 THEN '<nl>' ELSE '' END), '') AS markup FROM documents)"""


@query(f"""WITH m AS (SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(markup, '<(lcel|ucel|xcel)>', '<fcel>', 'g'), '<nl>', chr(10)), '<(ched|rhed|srow)>', '', 'g'), chr(10)) AS a FROM {OTSL}),
c AS (SELECT doc_id, list_transform(a, lambda l: list_transform(regexp_split_to_array(l, '{X.OTSL_CELL}'), lambda x: {TRIM('x')})) AS a FROM m)
SELECT doc_id, array_to_string(list_filter(list_transform(a, lambda l: {TRIM("array_to_string(CASE WHEN l[1] = '' THEN l[2:] ELSE l END, ' | ')")}), lambda x: x <> ''), chr(10)) AS rows FROM c""")
def from_otsl(spark, sf_dir):
    cell = lambda w, i: F.concat(F.when((i + 1) % 7 == 0, "<lcel>").otherwise("<fcel>"), w, F.when((i + 1) % 3 == 0, "<nl>").otherwise(""))
    markup = F.array_join(F.transform(F.split("text", " ", -1), cell), "")
    return documents(spark, sf_dir).select("doc_id", T.from_otsl(markup).alias("rows"))


def AGREEMENT(a: str, b: str) -> tuple[str, str]:
    n = f"(length({b}) // 24)"
    hits = f"len(list_filter(range(0, {n}), lambda i: contains({a}, substr({b}, i * 24 + 1, 24))))"
    cover = f"CASE WHEN {n} > 0 THEN {hits}::DOUBLE / {n} ELSE 0.0 END"
    return cover, f"(length({b}) >= 20 AND {n} > 0 AND ({cover}) >= 0.6)"


@query(f"""WITH n AS (SELECT doc_id, source, {NORM('text')} AS t FROM documents),
p AS (SELECT doc_id, t AS printed, lag(t) OVER (PARTITION BY source ORDER BY doc_id) AS read FROM n)
SELECT doc_id, {AGREEMENT('read', 'printed')[0]} AS cover, {AGREEMENT('read', 'printed')[1]} AS agrees FROM p WHERE read IS NOT NULL""")
def chunk_agreement(spark, sf_dir):
    """Each document against the one before it of its source. Pairs are made of ids alone; texts are joined to them."""
    from quire.operators.neighbours import previous

    docs = documents(spark, sf_dir)
    pairs = written(previous(docs, "source", "doc_id").filter(F.col("previous").isNotNull()).select("doc_id", "previous"), "pairs")
    found = pairs.join(docs.select("doc_id", "text"), "doc_id").join(docs.select(F.col("doc_id").alias("previous"), F.col("text").alias("read")), "previous")
    found = found.filter(F.col("read").isNotNull()).repartition("doc_id")  # the work is in the comparison, wherever the scan's splits lie
    return found.select("doc_id", *[v.alias(k) for k, v in T.agreement("read", "text").items()])


@query(f"""WITH d AS (SELECT doc_id, {NORM('text')} AS t FROM documents), b AS (SELECT item_id, {NORM('text')} AS t FROM benchmark),
x AS (SELECT doc_id, item_id, {AGREEMENT('d.t', 'b.t')[0]} AS cover, {AGREEMENT('d.t', 'b.t')[1]} AS agrees FROM d, b)
SELECT doc_id, item_id, cover FROM x WHERE agrees""")
def benchmark_agreement(spark, sf_dir):
    """Documents that hold most of a benchmark passage. Pairs that have enough pieces by their hashes are compared in full."""
    from quire.operators.passages import likely

    docs = documents(spark, sf_dir).select("doc_id", T.norm("text").alias("t"))
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", T.norm("text").alias("t"))
    pairs = written(likely(docs, passages, "doc_id", "item_id"), "pairs")
    both = pairs.join(docs, "doc_id").join(passages.withColumnRenamed("t", "b"), "item_id").select("doc_id", "item_id", T.agreement("t", "b")["cover"].alias("cover"))
    return both.filter("cover >= 0.6")


@query("""WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS a, max(turn) OVER (PARTITION BY conv_id) AS b, text FROM conversations)
SELECT conv_id, (turn + 1)::INT AS k, """ + TRIM("text") + """ AS part FROM c WHERE a = 0 AND b = n - 1""")
def numbered_split(spark, sf_dir):
    """Conversations written in the numbered protocol and split again."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    answers = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<<<"), (p["turn"] + 1).cast("string"), F.lit(">>>\n"), p["text"])), "\n").alias("answer"))
    split = answers.select("conv_id", F.posexplode(T.split_numbered("answer", F.col("n"))).alias("k", "part"))
    return split.select("conv_id", (F.col("k") + 1).alias("k"), "part")


@query("""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'it is one, ' WHEN 1 THEN 'one or two ' WHEN 2 THEN '{"verdict":" TWO ","reason":"r' || doc_id || '"}' ELSE 'nothing' END AS answer FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'one' WHEN 2 THEN 'two' END AS verdict, CASE WHEN doc_id % 4 = 2 THEN 'r' || doc_id ELSE '' END AS reason FROM v""")
def verdicts(spark, sf_dir):
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, "it is one, ").when(k == 1, "one or two ").when(k == 2, F.concat(F.lit('{"verdict":" TWO ","reason":"r'), F.col("doc_id").cast("string"), F.lit('"}'))).otherwise("nothing")
    options = F.array(F.lit("one"), F.lit("two"))
    return documents(spark, sf_dir).withColumn("answer", answer).select("doc_id", *[v.alias(n) for n, v in T.verdict("answer", options).items()])


@query("SELECT doc_id, substr(sha256('model-a' || chr(0) || text), 1, 32) AS k FROM documents")
def cache_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.cache_key(F.lit("model-a"), "text").alias("k"))


INNER = lambda f: f"trim(regexp_replace({f}, '^(\\\\[\\[(]|\\$\\$?)|(\\\\[\\])]|\\$\\$?)\\z', '', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '\\(x_{{' || doc_id || '}}\\)' WHEN 1 THEN '$y$' WHEN 2 THEN '\\[z\\]' WHEN 3 THEN '$$w$$' ELSE '$ open' END || ' end' AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, {quoted(T.INLINE)}) AS f, regexp_split_to_array(t, {quoted(T.INLINE)}) AS b FROM t),
s AS (SELECT doc_id, 2 * i AS k, 'text' AS kind, b[i] AS source FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM p)
 UNION ALL SELECT doc_id, 2 * i + 1, CASE WHEN {TRIM(INNER('f[i]'))} = '' THEN 'text' ELSE 'formula' END, f[i] FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM p))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS k, kind, source FROM s WHERE source <> ''""")
def formula_segments(spark, sf_dir):
    """Every document's whole text with a formula after it."""
    k = F.col("doc_id") % 5
    formula = F.when(k == 0, F.concat(F.lit("\\(x_{"), F.col("doc_id").cast("string"), F.lit("}\\)"))).when(k == 1, "$y$").when(k == 2, "\\[z\\]").when(k == 3, "$$w$$").otherwise("$ open")
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.formula_segments(F.concat("text", formula, F.lit(" end")))).alias("k", "s"))
    return rows.select("doc_id", "k", "s.kind", "s.source")


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' \\[ a_' || doc_id || ' \\] ' WHEN 1 THEN '$$b$$' ELSE 'c $$d$$' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' a_' || doc_id || ' ' WHEN 1 THEN 'b' END AS formula FROM f""")
def display_formulas(spark, sf_dir):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit(" \\[ a_"), F.col("doc_id").cast("string"), F.lit(" \\] "))).when(k == 1, "$$b$$").otherwise("c $$d$$")
    return documents(spark, sf_dir).withColumn("t", t).select("doc_id", T.display_formula("t").alias("formula"))


@query(f"""WITH s AS (SELECT doc_id, line, line_no, substr(regexp_replace({TRIM('line')}, '[^A-Za-z0-9_\\x{{4E00}}-\\x{{9FFF}}.]+', '-', 'g'), 1, 36) AS c FROM {LINES})
SELECT doc_id, line_no::INT AS line_no, CASE WHEN regexp_replace(c, '^-|-\\z', '', 'g') = '' THEN 's' || line_no ELSE 's' || line_no || '-' || regexp_replace(c, '^-|-\\z', '', 'g') END AS slug FROM s""")
def slugs(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.slug("line", "line_no").alias("slug"))


HEADING_LEVEL = lambda t, s, n, b: (
    f"CASE WHEN length({t}) > 120 OR len(regexp_split_to_array({t}, '{WS}+')) > 18 OR {n} > 3 THEN 0 WHEN {s} >= {b} + 4 THEN 1 WHEN {s} >= {b} + 1.6::DOUBLE THEN 2"
    f" WHEN {s} >= {b} - 0.4::DOUBLE AND regexp_matches({t}, '{X.NUMBERED_MODEL}') AND len(regexp_split_to_array({t}, '{WS}+')) <= 12 THEN 3 ELSE 0 END"
)


@query(f"""WITH l AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN line_no || '.1 ' || line ELSE line END AS t, (10 + line_no % 9)::DOUBLE AS size FROM {LINES})
SELECT doc_id, line_no::INT AS line_no, {HEADING_LEVEL('t', 'size', '1', '12.0::DOUBLE')} AS model_level, CASE WHEN size >= 19 THEN 1 WHEN size >= 16.5 THEN 2 WHEN size >= 13.5 THEN 3 ELSE 4 END AS size_level FROM l""")
def heading_levels(spark, sf_dir):
    t = F.when(F.col("line_no") % 5 == 0, F.concat(F.col("line_no").cast("string"), F.lit(".1 "), "line")).otherwise(F.col("line"))
    rows = lines(spark, sf_dir).withColumns({"t": t, "size": (10 + F.col("line_no") % 9).cast("double")})
    return rows.select("doc_id", "line_no", T.heading_level("t", "size", F.lit(1), F.lit(12.0)).alias("model_level"), T.level_by_size("size").alias("size_level"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(CASE page_id % 4 WHEN 0 THEN url || '/v1/chat/completions/' WHEN 1 THEN ' ' || url || '//' WHEN 2 THEN 'ftp:' || url ELSE url END), '/+\z', ''), '(?i)/(chat/completions|completions|responses)\z', '') AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u || '/chat/completions' END AS endpoint FROM u""")
def endpoints(spark, sf_dir):
    k = F.col("page_id") % 4
    typed = F.when(k == 0, F.concat("url", F.lit("/v1/chat/completions/"))).when(k == 1, F.concat(F.lit(" "), "url", F.lit("//"))).when(k == 2, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.endpoint(typed).alias("endpoint"))


@query(f"""WITH h AS (SELECT page_id, {TRIM("substr(CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '  ' ELSE '{\"error\": 1}' || page_id END, 1, 200)")} AS head FROM pages)
SELECT page_id, CASE WHEN regexp_matches(head, '(?i)^<(!doctype|html)') THEN 'html' WHEN head = '' THEN 'empty' ELSE head END AS said FROM h""")
def explained_errors(spark, sf_dir):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.col("html")).when(k == 1, "  ").otherwise(F.concat(F.lit('{"error": 1}'), F.col("page_id").cast("string")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.explain(raw).alias("said"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN [(doc_id % 50) + 0.4, (doc_id % 50) + 1.6]::DOUBLE[] END AS numbers FROM documents")
def number_ranges(spark, sf_dir):
    a = (F.col("doc_id") % 50).cast("string")
    b = (F.col("doc_id") % 50 + 1).cast("string")
    typed = F.when(F.col("doc_id") % 3 == 0, F.concat(a, F.lit(".4-"), b, F.lit(".6"))).when(F.col("doc_id") % 3 == 1, F.concat(a, F.lit(".4 ~ "), b, F.lit(".6"))).otherwise(F.concat(a, F.lit(", x")))
    return documents(spark, sf_dir).select("doc_id", T.number_range(typed).alias("numbers"))


@query("SELECT doc_id, sha256('data:image/webp;base64,' || base64(encode(text))) AS url_sha256, 'image/webp' AS media, octet_length(encode(text))::INT AS n_bytes, sha256(text) AS data_sha256 FROM documents")
def data_urls(spark, sf_dir):
    made = documents(spark, sf_dir).select("doc_id", T.data_url(F.lit("image/webp"), F.encode("text", "UTF-8")).alias("url"))
    back = made.withColumn("b", T.from_data_url("url"))
    return back.select("doc_id", F.sha2("url", 256).alias("url_sha256"), "b.media", F.octet_length("b.data").alias("n_bytes"), F.sha2("b.data", 256).alias("data_sha256"))


@query(f"""SELECT doc_id, {COLLAPSE("regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i % 4 = 0 THEN w || '-' ELSE w END), lambda w: w <> ''), chr(1)), '-' || chr(1), '', 'g'), chr(1), ' ', 'g')")} AS joined
FROM documents WHERE NOT contains(text, chr(1))""")
def joined_lines(spark, sf_dir):
    """The words as lines, every fourth hyphenated."""
    first = F.transform(F.split("text", " ", -1), lambda w, i: F.when((i + 1) % 4 == 0, F.concat(w, F.lit("-"))).otherwise(w))
    return documents(spark, sf_dir).select("doc_id", T.join_lines(F.filter(first, lambda w: w != "")).alias("joined"))
