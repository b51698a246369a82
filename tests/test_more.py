"""Neighbours, passages, streams of answers and of saves, ids, titles, audit questions and candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import library as L
from quire.operators import neighbours, packing, passages, streams
from quire.sources import tables


def test_previous_rows_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(0, 900, 3)] + [("b", 5), ("b", 2), (None, 7), (None, 9), ("one", 1)]
    df = spark.createDataFrame(rows, "source string, doc_id long").repartition(5)
    want = {}
    for s, d in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = [e for t, e in rows if t == s and e < d]
        want[s, d] = max(before, default=None)
    got = {(r["source"], r["doc_id"]): r["previous"] for r in neighbours.previous(df, "source", "doc_id").collect()}
    assert got == want and neighbours.previous(df.limit(0), "source", "doc_id").count() == 0
    places = {(r["source"], r["doc_id"]): r["place"] for r in neighbours.placed(df, "source", "doc_id").collect()}
    assert places == {(s, d): sum(t == s and e < d for t, e in rows) for s, d in rows}


def test_rolled_hashes():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" * 3, np.uint8)
    for n in (1, 2, 3, 7, 8, 13, 24):
        h = passages.rolled(data, n)
        assert len(h) == len(data) - n + 1 and len(set(h.tolist())) == 36 and (h[36:] == h[: len(h) - 36]).all()
        assert passages.rolled(data[5 : 5 + n], n)[0] == h[5]
    assert len(passages.rolled(data[:23], 24)) == 0


@pytest.mark.parametrize("held", [passages.HELD, 3])
def test_passages_are_found_anywhere(spark, monkeypatch, held):
    """Against looking for every whole piece in every text; with little held at once, in several passes."""
    monkeypatch.setattr(passages, "HELD", held)
    monkeypatch.setattr(passages, "SLICE", 50)
    rng = np.random.default_rng(2)
    words = lambda n: "".join(rng.choice(list("abcdefgh0123"), n))
    found = [(i, words(n)) for i, n in enumerate((24, 100, 23, 240, 0))] + [(5, "ab" * 60), (6, None)]
    bodies = [words(300) for _ in range(12)]
    bodies = [b[:k] + found[i % 4][1][: (30, 500)[i % 2]] + b[k:] for i, (b, k) in enumerate(zip(bodies, range(0, 300, 25), strict=True))] + ["ab" * 40, "", None]
    texts = list(enumerate(bodies))

    def share(text, passage):
        parts = [passage[i : i + 24] for i in range(0, len(passage) - 23, 24)]
        return sum(p in text for p in parts) / len(parts) if parts else 0.0

    want = {(d, p) for d, t in texts for p, b in found if share(t or "", b or "") >= 0.6}
    got = passages.likely(spark.createDataFrame(texts, "doc_id long, t string"), spark.createDataFrame(found, "item_id long, t string"), "doc_id", "item_id")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5


def test_answers_in_pieces_and_as_a_stream(spark, tmp_path):
    texts = [(1, "some words, " * 300), (2, ""), (3, "ünï \n 文字"), (4, "short")]
    chunks = streams.chunked(spark.createDataFrame(texts, "conv_id long, text string"), size=33)
    assert sorted(tuple(r) for r in streams.reassembled(chunks).collect()) == texts
    pieces = streams.answers(chunks, 100).filter("conv_id = 1").orderBy("piece").collect()
    assert len(pieces) > 20 and "".join(p["text"] for p in pieces) == texts[0][1] and [p["piece"] for p in pieces] == list(range(len(pieces)))
    rows = sorted(chunks.collect(), key=lambda r: (r["conv_id"], r["seq"]))
    for k in range(3):  # three batches of each conversation's chunks in order
        part = [r for r in rows if k * 40 <= r["seq"] < (k + 1) * 40 or (k == 2 and r["seq"] >= 120)]
        spark.createDataFrame(part, chunks.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    stream = streams.streamed(stream)
    stream.writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    said = spark.table("said").collect()
    for conv, text in texts:
        mine = sorted((r["seq"], r["text"]) for r in said if r["conv_id"] == conv)
        assert "".join(t for _, t in mine) == text
    assert len([r for r in said if r["conv_id"] == 1]) == 3


def test_saves_are_put_together(spark, tmp_path):
    rows = [(1, 0.0, "a"), (1, 0.3, "b"), (1, 0.6, "c"), (1, 2.0, "d"), (2, 0.1, "e")]
    df = spark.createDataFrame(rows, "doc_id long, t double, v string").withColumn("at", F.timestamp_seconds("t"))
    got = sorted((r["doc_id"], r["saves"], r["last"]["v"]) for r in L.debounced(df, ["doc_id"], "at").collect())
    assert got == [(1, 1, "d"), (1, 3, "c"), (2, 1, "e")]
    df.coalesce(1).write.parquet(str(tmp_path / "saves"))
    spark.createDataFrame([(9, 100.0, "late")], "doc_id long, t double, v string").withColumn("at", F.timestamp_seconds("t")).write.mode("append").parquet(str(tmp_path / "saves"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "saves")).withWatermark("at", "1 second")
    L.debounced(stream, ["doc_id"], "at").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["doc_id"], r["saves"], r["last"]["v"]) for r in spark.table("kept").collect()) == got  # the last one's quiet is not over


def test_ids_titles_and_first_rows(spark):
    one = spark.range(1).select(L.new_id(F.lit(1_700_000_000_000), F.lit("x")).alias("a"), L.new_id(F.lit(1_700_000_000_000), F.lit("x")).alias("b"), L.new_id(F.lit(1_700_000_000_000), F.uuid()).alias("c")).first()
    assert one["a"] == one["b"] != one["c"] and one["a"][:-5] == one["c"][:-5] == "dloyw3v28" and len(one["a"]) == 14
    rows = [(1, 0, "heading", " "), (1, 1, "para", "no"), (1, 2, "heading", "Titel**"), (1, 3, "heading", "B"), (2, 0, "heading", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_id long, kind string, zh string")
    assert [tuple(r) for r in L.translated_titles(blocks).collect()] == [(1, "Titel")]
    first = L.first_of(spark.range(10).withColumn("g", F.col("id") < 8), ["g"], [F.col("id")], 6).collect()
    assert {(r["g"], r["more"]) for r in first} == {(True, 2), (False, 0)} and len(first) == 8


def test_questions_and_candidates(spark):
    rows = spark.createDataFrame([("missing", "Figure 1. {x}"), ("split", None), ("other", "t")], "type string, text string")
    asked = {r["type"]: r for r in A.questions(rows).collect()}
    assert '"Figure 1. {x}"' in asked["missing"]["ask"] and asked["split"]["options"] == ["one", "two"] and asked["other"]["ask"] is None and asked["other"]["options"] == []
    blocks = spark.createDataFrame([(1, 0, k, "graphic", 0.0, 0.0, 9.0, 20.0) for k in range(4)] + [(1, 0, 9, "para", 0.0, 0.0, 9.0, 20.0)], "doc_id long, page int, block_id long, kind string, x0 double, y0 double, x1 double, y1 double")
    found = spark.createDataFrame([(1, 0, 0, "x" * 59 + "1", 11.0), (1, 0, 1, "x" * 60, 11.0), (1, 0, 2, "y" * 99, 10.9), (1, 0, 3, "z" * 99, 30.0), (1, 0, 9, "z" * 99, 30.0)], "doc_id long, page int, block_id long, under string, inky double")
    rows = A.ocr_candidates(blocks, found, most=2).orderBy("rank").collect()
    assert [(r["block_id"], r["dense"], r["skipped"]) for r in rows] == [(1, True, 1), (2, False, 1)]


def test_library_is_opened_taken_over_and_refused(spark, tmp_path):
    old = f"{tmp_path}/lib/v1"
    spark.createDataFrame([(1, "a", 10)], "id long, title string, created long").write.parquet(f"{old}/docs")
    spark.createDataFrame([("k", "z")], "k string, zh string").write.parquet(f"{old}/cache")
    lib = L.Library(spark, f"{tmp_path}/lib").open()
    assert [tuple(r) for r in lib.table("docs").select("id", "title", "pages").collect()] == [(1, "a", None)] and lib.table("cache").count() == 1
    assert all(lib.table(n).count() == 0 for n in ("blocks", "files", "highlights"))
    lib.remember(spark.createDataFrame([("l", "y")], "k string, zh string"))
    assert L.Library(spark, f"{tmp_path}/lib").open().table("cache").count() == 2  # opened again, nothing is taken over twice
    (tmp_path / "lib" / "v99").mkdir()
    with pytest.raises(ValueError, match="version 99"):
        L.Library(spark, f"{tmp_path}/lib").open()
    assert L.Library(spark, f"{tmp_path}/new").open().usage() >= 0


FITZ = """
class Page:
    def __init__(self, number, text):
        self.number, self.text = number, text

    def get_text(self, kind):
        span = lambda t, x: {"text": t, "size": 11.96, "font": "ABCDEF+Roman", "bbox": (x, 90.0, x + 5 * len(t), 104.0), "origin": (x, 100.0)}
        return {"blocks": [{"image": 1}, {"lines": [{"spans": [span(self.text, 72.0), span("  ", 100.0), span("end", 200.0)]}]}]}


class open:
    def __init__(self, stream, filetype):
        self.pages = [Page(k, t) for k, t in enumerate(stream.decode().split("|"))]

    def __enter__(self):
        return iter(self.pages)

    def __exit__(self, *a):
        pass
"""


def test_pdf_source_reads_what_a_library_says(spark, tmp_path):
    """With a stand-in for the PDF library at the workers: files to spans, page by page."""
    from quire.sources.pdf import PdfItems

    (tmp_path / "fitz.py").write_text(FITZ)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "in" / "notes.txt").write_bytes(b"x")
    spark.sparkContext.addPyFile(str(tmp_path / "fitz.py"))
    spark.dataSource.register(PdfItems)
    rows = spark.read.format("quire_pdf").load(str(tmp_path / "in")).orderBy("page", "seq").collect()
    assert [(r["page"], r["seq"], r["str"], r["size"], r["font"], r["x0"], r["y_base"]) for r in rows] == [(p, s, t, 12.0, "Roman", x, 100.0) for p, w in enumerate(("one", "two")) for s, t, x in ((0, w, 72.0), (1, "end", 200.0))]


def test_shared_folder_must_be_set_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())


def greedy(sizes, limit):
    out, used, batch = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


def test_effects_of_a_stretch_are_those_of_its_rows():
    """Whatever batch reaches a stretch, and wherever the stretch is cut off from the rows before it."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes, limit = rng.choice([0, 0, 1, 2, 3, 7, 12], rng.integers(1, 14)), 10
        told = packing.effects(sizes, limit)
        for used in range(15):
            batch, at = 0, used
            for n in sizes.tolist():
                if at and at + n > limit:
                    batch, at = batch + 1, 0
                at += n
            assert packing.after(told, used, limit) == (batch, at)


def test_a_hot_group_is_packed_in_ranges(spark):
    rng = np.random.default_rng(9)
    groups = {"hot": rng.choice([0, 1, 5, 40, 130], 3000).tolist(), "b": [5, 5, 200, 0, 1], None: [70, 40, 0, 0, 100], "c": [1]}
    rows = [(g, i, n if n else None) for g, own in groups.items() for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "source string, doc_id long, n long").repartition(6)
    got = {(r["source"], r["doc_id"]): r["batch"] for r in packing.packed(df, ["source"], "doc_id", "n", 100).collect()}
    assert got == {(g, i): b for g, own in groups.items() for i, b in enumerate(greedy(own, 100))}
    alone = packing.packed(df.filter("source = 'hot'"), [], "doc_id", "n", 100).collect()
    assert {r["doc_id"]: r["batch"] for r in alone} == dict(enumerate(greedy(groups["hot"], 100)))
    assert packing.packed(df.limit(0), ["source"], "doc_id", "n", 100).count() == 0


def test_entry_without_what_only_the_training_data_part_needs():
    """The engine's queries are there when a module that only quire.llm imports is not."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; from quire import catalog; assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
