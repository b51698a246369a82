"""What holds for large tables: nothing that grows comes to the driver, and words aren't dealt out where a document has them together."""

import pytest
from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import intervals as I
from quire.operators import pages as PG
from quire.plans import layout as LY
from quire.plans import pages as plans
from quire.sources import typeset as TS

TEXTS = [
    "A title\n" + "some words of running text, which go on and on. " * 90 + "\n\nand\tthe  end ",
    "", None, " ", "\n\n", "x" * 200 + " " + "y" * 85 + "\n" + "é ü 漢字 " * 30, "\n".join(f"line {k} of a long page" for k in range(140)), "a" * 89 + "\n" + "b" * 90, "a" * 90, "one " * 20 + "\r\n two",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of any kind, in a folder as queries read it."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, TEXTS[k % len(TEXTS)], "en", ["web", None, "books"][k % 3]) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


# --- F1: repaired_blocks ---


def test_repairs_bring_no_table_to_the_driver(spark, folder):
    plan = physical(plans.repaired_blocks(spark, folder))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("how", [{}, {"heads": False}, {"spaced": False}])
def test_documents_set_where_they_are_read_have_the_spans_of_the_rule(spark, folder, how):
    docs = documents(spark, folder)
    got = [(d, p, *span) for frame in TS.page_frames([docs.toPandas()], **how) for d, p, *fields in frame.itertuples(index=False) for span in zip(*(f.tolist() for f in fields), strict=True)]
    assert sorted(map(repr, got)) == as_rows(TS.typeset(docs, **how)) and len(got) > 5000


def test_runs_of_free_ink_by_pages_are_those_by_rows(spark, folder):
    ink, boxes = plans.G.ink_of(spark, folder), plans.G.boxes_of(spark, folder).withColumnRenamed("j", "block_id")
    ink = ink.withColumns({"on": F.expr("(y div 9 + doc_id) % 4 > 0"), "min_x": F.expr("if(y % 5 = 0, -1, 30 + y % 7)"), "max_x": F.expr("if(y % 5 = 0, -1, 40 + (y * doc_id) % 13)")})
    told = I.claims_of(boxes).join(I.with_rows(ink), ["doc_id", "page"])
    for how in ({"least_pt": 8}, {"least_pt": 12, "least_px": 3, "pads": (1, 1, 2, 1)}):
        rows = I.free_runs(ink.join(boxes.select("doc_id").distinct(), "doc_id"), I.covered_rows(boxes, ["doc_id", "page"], 0.5), ["doc_id", "page"], **how)
        assert as_rows(I.free_runs_of_pages(told, **how)) == as_rows(rows) and rows.count() > 100


# --- F2: suspects ---


def test_suspects_bring_no_table_to_the_driver(spark, folder):
    assert "Broadcast" not in physical(plans.suspects(spark, folder))


def test_texts_under_boxes_are_those_of_items_as_rows(spark, folder):
    graphics = plans.audit_tables(spark, folder)[0].filter("kind = 'graphic'")
    items = TS.typeset(documents(spark, folder), heads=False).withColumnRenamed("y_base", "y")
    got = plans.under_documents(spark, folder)(graphics)
    assert as_rows(got) == as_rows(A.under(graphics, items)) and got.count() > 5


def test_suspects_alike_in_all_that_orders_them_are_ranked_alike_in_every_run(spark):
    rows = [(1, 0, "missing", [], [], k, 0.0, 5.0, 9.0, 9.0, None, 2.5) for k in range(30)]
    ranks = [{r["cap_id"]: r["rank"] for r in A.worst(spark.createDataFrame(x, A.SUSPECTS).repartition(n)).collect()} for x, n in ((rows, 1), (rows[::-1], 1), (rows, 7))]
    assert ranks == [{k: k + 1 for k in range(30)}] * 3


# --- F4: folded_lines ---


def test_lines_are_folded_where_documents_are_read(spark, folder):
    assert "Exchange" not in physical(plans.folded_lines(spark, folder))


def test_frames_of_pages_are_bounded_by_their_spans():
    import pandas as pd

    docs = pd.DataFrame({"doc_id": range(40), "text": ["a b c d e\n" * 2000] * 40, "source": "web"})
    sizes = [sum(map(len, f["s_str"])) for f in TS.page_frames([docs])]
    assert max(sizes) < TS.FRAME_SPANS + 1000 and sum(sizes) == 40 * (2000 * 5 + 45) and len(sizes) > 5


# --- F3: block_kinds ---


def test_documents_teach_what_their_spans_teach(spark, folder):
    docs = documents(spark, folder)
    for got, want in zip(LY.profiled_documents(docs), LY.profiled(TS.typeset(docs)), strict=True):
        assert as_rows(got) == as_rows(want.select(*got.columns)) and want.count() > 3


def test_continued_texts_are_not_joined_to_their_blocks(spark):
    rows = [(1, 0, 0, "para", "It goes"), (1, 0, 1, "graphic", ""), (1, 1, 2, "para", "on here."), (1, 1, 3, "para", "New one.")]
    found = PG.continued(spark.createDataFrame(rows, "doc_id long, page int, block_id long, kind string, text string"))
    assert "Join" not in physical(found)
    assert [tuple(r) for r in found.orderBy("block_id").collect()] == [(1, 0, 0, "para", "It goes on here."), (1, 0, 1, "graphic", ""), (1, 1, 3, "para", "New one.")]
