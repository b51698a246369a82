"""Page folds, recognition, intervals and boxes: goldens, and restatements by brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import blocks as BK
from quire.operators import boxes as B
from quire.operators import intervals as I
from quire.operators import pages as P
from quire.operators import recognised as R


def span(text, x0, y, size=10.0, font="Roman"):
    return P.Span(text, size, font, x0, x0 + 5 * len(text), y, y - 0.78 * size, y + 0.24 * size)


def test_a_lines_reach_is_from_its_first_baseline():
    lines = P.lines_of([span("a", 0, 100), span("b", 10, 106), span("c", 20, 112)], 0.62)
    assert [x.text for x in lines] == ["ab", "c"]  # 112 is within reach of 106 but not of 100


def test_the_first_of_equal_weights_dominates():
    assert P.weightiest([(12, 3), (10, 3)]) == 12 and P.weightiest([(10, 0), (11, 2)]) == 11 and P.weightiest([]) is None


def test_blank_spans_are_not_separators():
    assert P.lines_of([span("0.288", 0, 1), span("0.413", 40, 1)], 0.62)[0].text == "0.2880.413"


def page(shift, rows=20):
    return [span("left words", 72, 100 + 14 * i) for i in range(rows)] + [span("more", 150, 100 + 14 * i) for i in range(rows)] + [span("right words", 330, 100 + 14 * i + shift) for i in range(rows)] + [span("here", 400, 100 + 14 * i + shift) for i in range(rows)]


def test_columns_are_told_from_tables_by_baselines():
    assert P.column_cut(page(5), 612, 792, 6) == pytest.approx(250, abs=16) and P.column_cut(page(0), 612, 792, 6) is None
    assert P.column_cut(page(5)[:30], 612, 792, 6) is None


def test_gap_centre():
    assert P.gap_centre([span("x" * 40, 72, 1), span("y" * 20, 330, 1)], 612, 6) == pytest.approx((273 + 330) / 2)
    assert P.gap_centre([span("x" * 80, 72, 1)], 612, 6) is None


def line(text, x0, y, x1=540.0, size=12.0, font="Roman"):
    s = P.Span(text, size, font, x0, x1, y, y - 0.78 * size, y + 0.24 * size)
    return P.Line([s], text=text, size=size, font=font, spans=[s])


BOUNDS = P.Bounds(96.0, 470.0)


def grouped(lines):
    return [[x.text for x in b.parts] for b in P.blocks_of(lines, BOUNDS, 1.65)]


def test_lines_become_blocks():
    assert grouped([line("one", 72, 100), line("two", 72, 114), line("far", 72, 170)]) == [["one", "two"], ["far"]]
    assert grouped([line("body", 72, 100), line("note", 72, 114, size=10.0)]) == [["body"], ["note"]]
    assert grouped([line("head", 72, 100, font="X-Bold"), line("body", 72, 114)]) == [["head"], ["body"]]
    # first-line indents start paragraphs; hanging indents end entries
    assert grouped([line("a", 72, 100), line("b", 72, 114), line("c", 90, 128), line("d", 72, 142)]) == [["a", "b"], ["c", "d"]]
    assert grouped([line("a", 72, 100), line("b", 90, 114), line("c", 72, 128)]) == [["a", "b"], ["c"]]


def test_hyphens_and_parts():
    assert P.joined([line("hy-", 72, 1), line("phen", 72, 2)]) == "hyphen" and P.joined([line("hy-", 72, 1), line("phen", 72, 2)], hyphens=False) == "hy- phen"
    two = [line("2 Context and aims", 72, 1, size=18), line("2.1 Asset pricing", 72, 2, size=14)]
    assert [len(p) for p in P.parted(two, 13.5)] == [1, 1] and len(P.parted([two[0], line("a,b", 72, 2, size=9)], 13.5)) == 1


def test_continued_paragraphs(spark):
    rows = [(0, "para", "It goes", 0), (1, "note", "1 foot", 0), (2, "para", "on here", 1), (3, "para", "and on.", 2), (4, "para", "small but ended before", 3), (5, "para", "same page", 3), (6, "heading", "H", 3)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, block_id long, kind string, text string, page int")
    got = [(r["block_id"], r["text"]) for r in P.continued(df).orderBy("block_id").collect()]
    assert got == [(0, "It goes on here and on."), (1, "1 foot"), (4, "small but ended before"), (5, "same page"), (6, "H")]


# --- recognition ---


def test_markdown():
    text = "# Head\npara one\nmore\n\n| a | b |\n| c | d |\nFigure 1. cap\n\\[ x\ny \\]\n$$z$$\nlast\n$$open\nend"
    assert R.split_markdown(text) == [("heading", "Head"), ("para", "para one\nmore"), ("table", "| a | b |\n| c | d |"), ("caption", "Figure 1. cap"), ("math", "\\[ x\ny \\]"), ("math", "$$z$$"), ("para", "last"), ("math", "$$open\nend")]
    assert R.split_markdown("") == [] and R.split_markdown("\n\n") == []


def test_claims_prefer_the_block_nearest_to_the_last():
    blocks = ["alpha beta gamma", "delta epsilon", "alpha beta again"]
    assert R.claims(blocks, ["delta epsilon", "alpha beta", "ab", "nowhere at all"]) == [1, 0, None, None]
    assert R.claims(blocks, ["alpha beta again", "alpha beta"]) == [2, 2]


def test_fallback(spark):
    at = lambda k, t, y, x=72.0: (1, 0, k, t, 10.04, x, 300.0, y, y + 10)
    rows = [at(0, "a-", 0.0), at(1, "b", 12.0), at(2, "c", 40.0), at(3, "d", 52.0, 200.0), at(4, "e", 64.0, 180.0), at(5, "f", 76.0, 171.0), at(6, "g", 88.0, 169.9)]
    found = R.fallback_blocks(spark.createDataFrame(rows, R.LINES.replace("size double, x0 double, x1", "size double, x0 double, x1"))).orderBy("seq").collect()
    assert [b["text"] for b in found] == ["a-b", "c", "d e f", "g"]  # flush with the paragraph's first line, not with the last
    assert (found[0]["size"], found[0]["y1"], found[2]["n_lines"]) == (10.0, 22.0, 3)


def test_recognise(spark):
    said = {b"t": "<fcel>a<fcel>b<nl>", b"p": "the same words that stand on the page, all of them", b"e": "", b"r": "\n".join(["again"] * 9)}

    def client(image):
        if image == b"x":
            raise OSError("no connection")
        return said[image]

    page = "The same words that stand on the page, all of them."
    rows = R.recognise(spark.createDataFrame([(i, bytearray(k), page) for i, k in enumerate([b"t", b"p", b"e", b"r", b"x"])], "id long, image binary, printed string"), lambda b: client(bytes(b))).orderBy("id").collect()
    assert [r["why"] for r in rows] == ["not on the page", None, "empty", "repeats itself", "no connection"] and rows[0]["text"] == "a | b" and rows[1]["ok"]


# --- intervals and boxes ---


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), min_size=1, max_size=30), st.randoms())
def test_islands(spark, found, order):
    rows = [(i, a, a + n) for i, (a, n) in enumerate(found)]
    want, reach = [], None
    for i, a, b in sorted(rows, key=lambda r: (r[1], r[0])):
        if reach is not None and a <= reach:
            want[-1] = (want[-1][0], max(want[-1][1], b), [*want[-1][2], i])
        else:
            want.append((a, b, [i]))
        reach = want[-1][1]
    order.shuffle(rows)
    df = spark.createDataFrame([(1, *r) for r in rows], "block long, id int, start int, end int")
    merged = I.merged_ranges(df, ["block"])
    assert [tuple(r) for r in merged.orderBy("start").select("start", "end", "ids").collect()] == want
    again = I.merged_ranges(merged.select("block", F.col("island").alias("id"), "start", "end"), ["block"])
    assert again.count() == len(want)  # merging what is merged changes nothing


def test_merged_runs(spark):
    df = spark.createDataFrame([(1, 0, 0.0, float(a), 9.0, float(b)) for a, b in ((0, 10), (20, 30), (41, 50))], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert [(r["y0"], r["y1"]) for r in I.merged_boxes(df, ["doc_id", "page"], 10).orderBy("y0").collect()] == [(0, 30), (41, 50)]


def test_overlaps(spark):
    def of(f, a, b):
        return spark.range(1).select(f(tuple(map(F.lit, a)), tuple(map(F.lit, b)))).first()[0]

    a = (0.0, 0.0, 10.0, 10.0)
    assert of(B.overlap_ratio, a, (5.0, 0.0, 15.0, 10.0)) == 0.5 and of(B.h_overlap, a, (5.0, 0.0, 7.0, 10.0)) == 1.0
    assert of(B.y_overlap, a, (0.0, 5.0, 1.0, 25.0)) == 0.25 and of(B.h_overlap, a, (5.0, 0.0, 5.0, 1.0)) == 0.0


def test_pieces_over_a_page_end(spark):
    def pairs(*rows):
        df = spark.createDataFrame([(1, i, p, "graphic", 72.0, y0, 400.0, y1, y1 - y0) for i, (p, y0, y1) in enumerate(rows)], "doc_id long, seq int, page int, kind string, x0 double, y0 double, x1 double, y1 double, h double")
        dims = spark.createDataFrame([(1, p, 792.0) for p in range(5)], "doc_id long, page int, height double")
        return [(r["seq"], r["with_seq"]) for r in B.stitch_pairs(df, dims).orderBy("seq").collect()]

    assert pairs((0, 400.0, 700.0), (1, 60.0, 700.0), (2, 60.0, 300.0)) == [(0, 1)]  # the second is taken
    assert pairs((0, 400.0, 657.0), (1, 60.0, 300.0)) == []  # 135 points to the page's end are too many


def test_places(spark):
    df = spark.createDataFrame([(1, 0, "heading", "A", 20.0, 0), (1, 1, "heading", "B", 20.0, 0), (1, 2, "para", "x", 12.0, 0), (1, 3, "heading", "C", 30.0, 5)], "doc_id long, block_id long, kind string, text string, size double, page int").withColumn("zh", F.lit(None).cast("string"))
    assert tuple(BK.title(df).first()) == (1, 0, "A")
    assert [r["text"] for r in BK.contents(df).orderBy("block_id").collect()] == ["B", "C"]
    near = BK.context(df, spark.createDataFrame([(1, 2)], "doc_id long, block_id long")).first()["context"]
    assert near == "x\n\nB\n\nC\n\nA" and BK.context(df, spark.createDataFrame([(1, 2)], "doc_id long, block_id long"), in_order=True).first()["context"] == "A\n\nB\n\nx\n\nC"


def test_model_references(spark):
    rows = [(0, "heading", "References:", 14.0), (1, "para", "r", 10.0), (2, "graphic", "", 10.0), (3, "heading", "small", 12.0), (4, "para", "s", 10.0), (5, "heading", "Appendix", 13.7), (6, "para", "t", 10.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, block_id long, kind string, text string, size double")
    assert [r["kind"] for r in BK.references(df, model=True).orderBy("block_id").collect()] == ["heading", "ref", "graphic", "heading", "ref", "heading", "para"]
    assert [r["kind"] for r in BK.references(df.replace("References:", "References*")).orderBy("block_id").collect()] == ["heading", "ref", "heading", "ref", "heading", "ref"]
