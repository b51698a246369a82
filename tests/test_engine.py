"""Audit, translation, library, sources and streams; and every query with SQL against that SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import catalog
from quire.operators import audit as A
from quire.operators import library as L
from quire.operators import streams
from quire.operators import translate as TR
from quire.sources import docjson, script
from quire.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    found, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in found.columns]
    got = sorted(repr(tuple(map(plain, r))) for r in found.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(entry.queries())


def test_queries_read_what_they_need(spark):
    from quire.plans import library, text

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(text.text_metrics(spark, SF))
    listing = plan(library.doc_listing(spark, SF).select("id", "title"))
    assert "source" in listing


# --- audit ---

BLOCK = "doc_id long, page int, block_id long, kind string, text string, size double, x0 double, y0 double, x1 double, y1 double"
ITEM = "doc_id long, page int, str string, size double, x0 double, x1 double, y double"
PROSE = "we show that the model of the market is not in its own way a good one for all who trade. It is what we expect of them"


def tables(spark, blocks, items=(), ink=()):
    return spark.createDataFrame([(1, 0, *b) for b in blocks], BLOCK), spark.createDataFrame([(1, 0, *i) for i in items], ITEM), spark.createDataFrame([(1, 0, *r) for r in ink], "doc_id long, page int, y int, on boolean, min_x int, max_x int")


def prose_items(y=110.0, rows=4):
    words = PROSE.split()
    per = -(-len(words) // rows)
    return [(" ".join(words[i * per : (i + 1) * per]) + " ", 12.0, 80.0, 500.0, y + 14 * i) for i in range(rows)]


def test_text_taken_for_an_image(spark):
    blocks, items, ink = tables(spark, [(0, "graphic", "", 0.0, 72.0, 100.0, 540.0, 170.0), (1, "para", "x", 12.0, 72.0, 400.0, 540.0, 420.0)], prose_items())
    found = A.scan(blocks, items, ink).collect()
    assert [(r["type"], r["ids"]) for r in found] == [("text-as-image", [0])] and found[0]["severity"] == pytest.approx(1 + len(found[0]["text"]) / 400)
    fixed = A.repaired(blocks, A.scan(blocks, items, ink)).orderBy("block_id").first()
    assert fixed["kind"] == "para" and fixed["text"].startswith("we show that")
    assert A.scan(blocks, items.withColumn("str", F.concat(F.lit("∑∂ "), "str")), ink).count() == 0


def test_one_figure_in_pieces(spark):
    rows = [(0, "graphic", "", 0.0, 72.0, 100.0, 400.0, 150.0), (1, "para", "TGP", 12.0, 80.0, 160.0, 390.0, 170.0), (2, "graphic", "", 0.0, 72.0, 180.0, 400.0, 230.0), (3, "para", "after", 12.0, 72.0, 240.0, 400.0, 250.0), (4, "caption", "Figure 1. x", 12.0, 72.0, 260.0, 400.0, 270.0)]
    blocks, items, ink = tables(spark, rows)
    found = [r for r in A.scan(blocks, items, ink).collect() if r["type"] == "split"]
    assert [(r["ids"], r["mid_ids"], r["y0"], r["y1"]) for r in found] == [([0, 2], [1], 100.0, 230.0)] and found[0]["severity"] == pytest.approx(2.2)
    fixed = A.repaired(blocks, A.scan(blocks, items, ink).filter("type = 'split'")).orderBy("block_id").collect()
    assert [r["block_id"] for r in fixed] == [0, 3, 4] and fixed[0]["y1"] == 230.0


def test_figures_cut_short_and_missing(spark):
    ink = [(y, True, 40, 200) for y in range(40, 90)] + [(y, True, 40, 200) for y in range(300, 330)]
    rows = [(0, "graphic", "", 0.0, 80.0, 80.0, 400.0, 140.0), (1, "caption", "Table 2. y", 12.0, 80.0, 665.0, 400.0, 680.0)]
    blocks, items, inked = tables(spark, rows, (), ink)
    found = {r["type"]: r for r in A.scan(blocks, items, inked).collect()}
    assert set(found) == {"cut", "missing"} and found["cut"]["y1"] == pytest.approx(180.0) and found["missing"]["cap_id"] == 1
    fixed = A.repaired(blocks, A.scan(blocks, items, inked)).orderBy("place").collect()
    assert [(r["block_id"], r["kind"]) for r in fixed] == [(0, "graphic"), (2, "graphic"), (1, "caption")]  # the figure goes before its caption
    assert A.scan(blocks.filter("block_id = 7"), items, inked).count() == 0


def test_budget_verdicts_and_report(spark):
    blocks, items, ink = tables(spark, [(0, "graphic", "", 0.0, 72.0, 100.0, 540.0, 170.0)], prose_items())
    found = A.scan(blocks, items, ink)
    assert A.worst(found, 0).count() == 0 and A.sure_without_looking(found).count() == 0
    assert A.report(found, found.limit(0)).first()["fixed"] == 0
    assert found.select(A.options_of("type").alias("o")).first()["o"] == ["text", "graphic"]
    read = spark.createDataFrame([(1, 0, 0, "We show that", "text", True)], "doc_id long, page int, block_id long, text string, shape string, ok boolean")
    merged = A.ocr_merged(blocks, read, A.under(blocks, items)).first()
    assert (merged["kind"], merged["text"], merged["ocr"]) == ("para", "We show that", "We show that")
    noted = A.ocr_merged(blocks, read.withColumn("shape", F.lit("table")), A.under(blocks, items)).first()
    assert (noted["kind"], noted["text"], noted["ocr"]) == ("graphic", "", "We show that")


# --- translation ---


def blocks_of(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, "para", t, None) for i, t in enumerate(texts)], "doc_id long, block_id long, kind string, text string, zh string")


@pytest.mark.parametrize(("sizes", "batches"), [([5, 5, 5, 3, 9], [0, 0, 1, 1, 2]), ([25, 1], [0, 1]), ([10, 10], [0, 1])])
def test_packing(spark, sizes, batches):
    rows = TR.packed(blocks_of(spark, ["x" * n for n in sizes]), ["doc_id"], "block_id", 10).orderBy("block_id").collect()
    assert [r["batch"] for r in rows] == batches


def test_translation_falls_back_and_records_errors(spark):
    def client(system, user):
        if "bad" in user and "<<<" not in user:
            raise OSError("refused")
        return "no markers" if "<<<" in user else f"Z {user}"

    none = spark.createDataFrame([], "k string, zh string")
    settings = TR.Settings(pause=0.0, retry=2, batch_chars=14)
    out, fresh = TR.translate(blocks_of(spark, ["one", "two", " ", "bad news here"]), none, client, settings)
    rows = out.orderBy("block_id").collect()
    assert [r["zh"] for r in rows] == ["Z one", "Z two", None, ""] and rows[3]["err"] == "refused" and fresh.count() == 2
    again, more = TR.translate(blocks_of(spark, ["two", "three"], 2), fresh, client, settings)
    assert [r["zh"] for r in again.orderBy("block_id").collect()] == ["Z two", "Z three"] and more.count() == 1


def test_settings_overlay():
    assert TR.Settings().overlaid({"batch_chars": 500, "retry": "x", "other": 1}) == TR.Settings(batch_chars=500) and TR.Settings().overlaid(None) == TR.Settings()


# --- library ---


def test_library(spark, tmp_path):
    lib = L.Library(spark, str(tmp_path))
    assert lib.table("docs").count() == 0 and lib.usage() == 0
    empty = {n: lib.table(n).limit(0) for n in L.TABLES}
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, title string, created long")
    lib.put("docs", empty["docs"].unionByName(docs, allowMissingColumns=True))
    lib.put("blocks", empty["blocks"].unionByName(blocks_of(spark, ["x", "y"]).withColumn("zh", F.when(F.col("block_id") == 0, "z")), allowMissingColumns=True))
    lib.put("docs", empty["docs"].unionByName(spark.createDataFrame([(1, "c", 30)], "id long, title string, created long"), allowMissingColumns=True))
    rows = L.listing(lib.table("docs"), lib.table("blocks")).collect()
    assert [(r["id"], r["title"], r["n_blocks"], r["n_translated"]) for r in rows] == [(1, "c", 2, 1), (2, "b", 0, 0)]
    lib.drop(1)
    assert [r["id"] for r in lib.table("docs").collect()] == [2] and lib.table("blocks").count() == 0
    lib.remember(spark.createDataFrame([("k", "z"), ("k", "z")], "k string, zh string"))
    lib.remember(spark.createDataFrame([("k", "y"), ("l", "x")], "k string, zh string"))
    assert lib.table("cache").count() == 2 and lib.usage() > 0
    lib.forget()
    assert lib.table("cache").count() == 0


def test_painted_text(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "plain")], "block_id long, text string")
    ranges = spark.createDataFrame([(1, 1, 3), (1, 4, 99)], "block_id long, start int, end int")
    rows = [(r["block_id"], r["marked"], r["source"]) for r in L.painted(texts, ranges, ["block_id"]).orderBy("block_id", "k").collect()]
    assert rows == [(1, False, "a"), (1, True, "bc"), (1, False, "d"), (1, True, "ef"), (2, False, "plain")]


# --- sources and streams ---

SCRIPT = "@meta\ntitle-en: A title\nfile: f.pdf\n@page 2\n@h1\nHead\n--\nKopf\n@p\nfirst\nsecond\n\nthird\n@note\n\n@fig 1, 2 3 4\n@page 3\n@ref\nEntry\n"


def test_script(spark):
    lines = script.tagged_lines(spark.createDataFrame([(1, SCRIPT)], "doc_id long, text string"))
    rows = script.blocks(lines).orderBy("block_id").collect()
    assert [(r["block_id"], r["kind"], r["level"], r["page"], r["text"], r["zh"]) for r in rows] == [(0, "heading", 1, 2, "Head", "Kopf"), (1, "para", None, 2, "first\nsecond\n\nthird", ""), (2, "graphic", None, 2, "", None), (3, "ref", None, 3, "Entry", "")]
    assert rows[2]["y1"] == 4.0 and script.faults(lines).count() == 0
    bad = script.tagged_lines(spark.createDataFrame([(1, "stray\n@what\n@fig 1 2\n@page x\n@p\nfine")], "doc_id long, text string"))
    assert [(r["line_no"], r["fault"]) for r in script.faults(bad).orderBy("line_no").collect()] == [(0, "text outside of a block"), (1, "unknown tag"), (2, "figure needs four coordinates"), (3, "page needs a number")]
    built = script.document(script.blocks(lines), script.meta(lines), 5).first()["json"]
    parsed = docjson.parse(spark.createDataFrame([(1, "n.json", built), (2, "x.JSON", '{"blocks":[{"kind":"para","text":"t","img":"data:image/png;base64,aGk="}]}'), (3, "b", "{broken"), (4, "c", '{"title":"no blocks"}')], "doc_id long, name string, json string"))
    docs = {r["id"]: r for r in docjson.docs(parsed, 9).collect()}
    assert set(docs) == {1, 2} and docs[1]["title"] == "A title" and docs[1]["pages"] == 3 and docs[1]["created"] == 5 and (docs[2]["title"], docs[2]["pages"], docs[2]["created"]) == ("x", 1, 9)
    imported = docjson.blocks(parsed).orderBy("doc_id", "block_id").collect()
    assert [r["page"] for r in imported] == [1, 1, 1, 2, 0] and bytes(imported[-1]["image"]["data"]) == b"hi"


def test_events_are_put_together(spark):
    texts = spark.createDataFrame([(1, "Grüße, 世界! " * 9), (2, ""), (3, "x")], "conv_id long, text string")
    for size in (1, 7, 50):
        assert {r["conv_id"]: r["text"] for r in streams.reassembled(streams.chunked(texts, size=size)).collect()} == {1: "Grüße, 世界! " * 9, 2: "", 3: "x"}
    assert list(streams.deltas(iter(["event: x", "data: {broken", 'data: {"choices":[]}', 'data: {"choices":[{"delta":{"content":"a"}}]}', "data: [DONE]"]))) == ["a"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(50).coalesce(1).write.parquet(source)
    run = lambda: ingest.ingest(spark, source, ingest.DOCUMENTS, lambda b, n: seen.append((n, b.count())), str(tmp_path / "cp"))
    run()
    run()
    docs.filter("doc_id >= 190").coalesce(1).write.mode("append").parquet(source)
    run()
    assert seen == [(0, 50), (1, 10)]


def test_subpackage_is_not_imported_by_the_rest():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "quire")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "quire.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
