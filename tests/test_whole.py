"""Queries do the whole job: whole elements, whole texts, every row."""

import re

from quire.operators import translate as TR
from quire.plans import text as P
from quire.sources import html

# --- pages ---

PAGE = """<html><head><title>t</title><script>"</p>"</script></head><body><nav><ul><li><a href="/a">one</a></li><li><i>two</i> more<ul><li>in</li></ul>tail</li></ul></nav>
<article><h1>H <em>e</em>f</h1><p><b>bold</b> rest<br>after<p>open, 1 < 2 <img src="x">on</article>loose<table><tr><td><a>c</a>1<td>2<p>in cell</table><img>own <b>text</b><div>none</div><figcaption>F<!-- x --> g</figcaption></body></html>"""


def test_elements_have_their_whole_text(spark):
    rows = html.blocks(spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<p><b>cut")], "page_id long, html string")).orderBy("page_id", "seq").collect()
    assert [(r.page_id, r.tag, r.text) for r in rows] == [
        (1, "li", "one"), (1, "li", "two more tail"), (1, "li", "in"), (1, "h1", "H ef"), (1, "p", "bold rest after"), (1, "p", "open, 1 < 2 on"), (1, "img", ""),
        (1, "td", "c1"), (1, "td", "2"), (1, "p", "in cell"), (1, "img", "own text"), (1, "figcaption", "F g"), (4, "p", "cut"),
    ]
    assert [r.seq for r in rows] == [*range(12), 0] and (rows[3].kind, rows[3].level, rows[6].kind) == ("heading", 1, "graphic")


# --- texts ---

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def brute_segments(text):
    """The pieces of a text one after another, by looking for the first formula from each place."""
    out, at = [], 0
    for m in re.finditer(r"\\\[([^\0]*?)\\\]|\$\$([^\0]*?)\$\$|\\\(([^\0]*?)\\\)|\$([^$\n]{1,200}?)\$", text):
        inner = next(g for g in m.groups() if g is not None)
        out += [("text", text[at : m.start()]), ("formula" if inner.strip() else "text", m[0])]
        at = m.end()
    return [s for s in [*out, ("text", text[at:])] if s[1]]


def test_formula_segments_of_whole_texts(spark, tmp_path):
    texts = ["one line", "first $a$ line\nsecond \\(b\\) and $$c\nd$$", "costs $5\nand \\[e\nf\\] \\ g", "", "\\( \\)\n$$ $$ $h$", "x\ny\n$i", "$j\nk$ l$"]
    planted = lambda i: (f"\\(x_{{{i}}}\\)", "$y$", "\\[z\\]", "$$w$$", "$ open")[i % 5] + " end"
    found = P.formula_segments(spark, documents(spark, tmp_path, texts)).orderBy("doc_id", "k").collect()
    assert [tuple(r) for r in found] == [(i, k, *s) for i, t in enumerate(texts) for k, s in enumerate(brute_segments(t + planted(i)))]
    assert sum(r.kind == "formula" for r in found) > 10


def test_joined_lines_of_every_document(spark, tmp_path):
    found = P.joined_lines(spark, documents(spark, tmp_path, ["a b c d e", "a\x01 b-\x01c - d e", "", "a b c d"])).orderBy("doc_id").collect()
    assert [r.joined for r in found] == ["a b c de", "a\x01 b-\x01c de", "", "a b c d-"]


# --- translation ---


def test_packed_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, "aaaa"), (None, 2, "bbbb"), (None, 3, "cc"), (7, 1, "aaaa"), (7, None, None)], "source long, doc_id long, text string")
    found = TR.packed(rows, ["source"], "doc_id", 6)
    assert found.columns == ["source", "doc_id", "text", "batch"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(None, 1, "aaaa", 0), (None, 2, "bbbb", 1), (None, 3, "cc", 1), (7, 1, "aaaa", 0), (7, None, None, 0)]))


def test_translated_keeps_long_documents_apart(spark):
    rows = [(1, 1_000_000, "para", "see", None), (2, 0, "para", "tree", None), (None, 0, "para", "me", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_id long, kind string, text string, zh string")
    out, _ = TR.translate(blocks, spark.createDataFrame([], "k string, zh string"), TR.offline_client, TR.Settings(pause=0.0))
    assert sorted((r.text, r.zh, r.err) for r in out.collect()) == [("me", "mE", None), ("see", "sEE", None), ("tree", "trEE", None)]
