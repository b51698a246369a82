"""Regions, pixels, markup and the chat client."""

import http.server
import json
import threading

import numpy as np
import pytest

from quire.functions.markup import markdown_html
from quire.operators import recognised as R
from quire.operators import regions as G
from quire.operators.profile import Layout
from quire.sources import client as C
from quire.sources import items, script

LAYOUT = {k: float(v) for k, v in vars(Layout()).items()}


def ink(*bands, height=396):
    on = np.zeros(height, bool)
    for a, b in bands:
        on[a:b] = True
    return G.Ink(on, np.where(on, 40, -1), np.where(on, 200, -1))


def test_boxes_are_bridged_by_ink_only():
    a, b = [80.0, 100.0, 300.0, 120.0], [80.0, 180.0, 300.0, 200.0]
    assert len(G.merged([a, b], [], ink(), LAYOUT, 612, 792)) == 2
    assert G.merged([b, a], [], ink((70, 75)), LAYOUT, 612, 792) == [[72.0, 92.0, 308.0, 208.0]]
    assert len(G.merged([a, b], [[80.0, 140.0, 300.0, 150.0]], ink((70, 75)), LAYOUT, 612, 792)) == 2  # text lies between
    assert G.merged([[0.0, 0.0, 9.0, 7.0]], [], ink(), LAYOUT, 612, 792) == []


def test_figures_without_text_are_found():
    assert G.free_figures([], ink((100, 140)), 40) == [[76.0, 196.0, 406.0, 284.0]]
    assert G.free_figures([[0.0, 200.0, 612.0, 300.0]], ink((100, 140)), 40) == [] and G.free_figures([], ink((100, 110)), 40) == []


def test_regions_grow_along_ink():
    box = [80.0, 200.0, 400.0, 300.0]
    assert G.expanded(box, ink((90, 170)), []) == [80.0, 180.0, 400.0, 338.0]
    assert G.expanded(box, ink((90, 170)), [[72.0, 310.0, 540.0, 320.0]])[3] == 306.0  # body text stops it
    assert G.expanded([80.0, 200.0, 400.0, 270.0], ink((90, 170)), []) == [80.0, 200.0, 400.0, 270.0]
    held = np.zeros(396, bool)
    assert G.grown(box, ink((95, 155)), held, 24)[1::2] == [189.0, 309.0]
    held[152] = True
    assert G.grown(box, ink((95, 155)), held, 24)[3] == 303.0


def test_regions_are_trimmed_to_texts():
    box = [80.0, 100.0, 400.0, 200.0]
    assert G.trimmed(box, [[72.0, 195.0, 540.0, 215.0]], 8, 2.8) is not None
    assert G.trimmed(box, [[72.0, 199.5, 540.0, 215.0]], 8, 2.8)[3] == 198.5
    assert G.trimmed([80.0, 100.0, 400.0, 105.0], [], 8, 2.8) is None
    assert G.trimmed([80.0, 100.0, 400.0, 120.0], [[70.0, 90.0, 500.0, 130.0]], 8, 2.8) is None  # a scrap inside a paragraph


def test_bands_of_pixels():
    mask = np.zeros((100, 300), bool)
    mask[10:30, 20:200] = True
    mask[34:40, 20:200] = True  # four rows apart: the same band
    mask[60:97, 20:200] = True
    assert G.free_mask_runs(mask, [], 8) == [[34.0, 14.0, 406.0, 86.0]]  # the last one touches the page's end
    assert len(G.free_mask_runs(mask, [], 8, to_the_end=True)) == 2
    assert G.free_mask_runs(mask, [[0.0, 0.0, 612.0, 90.0]], 8) == []


def test_pixels():
    image = np.full((396, 306, 3), 255, np.uint8)
    image[5:20, 10:300] = 0
    mask, rows = G.ink_of_pixels(image)
    assert rows.rows.sum() == 15 and (rows.min_x[5], rows.max_x[5]) == (10, 299)
    found = G.banners(mask, 612, 792)
    assert len(found) == 1 and (G.blanked(image, found) == 255).all()
    assert G.cropped(image, [20.0, 10.0, 600.0, 40.0], 0.5).shape == (15, 290, 3) and G.cropped(image, [20.0, 10.0, 600.0, 40.0], 0.5, 100).shape[1] <= 100


def test_labels_notes_and_images(spark):
    rows = [(1, 0, "math", "x", None), (1, 1, "math", "y", 5.0), (1, 2, "table", "t", None), (1, 3, "para", "p", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, kind string, text string, x0 double")
    assert [(r["kind"], r["text"], r["ocr"]) for r in R.kept_as_images(df).orderBy("seq").collect()] == [("math", "x", None), ("graphic", "", "y"), ("para", "t", None), ("para", "p", None)]
    rows = [(1, 0, "para", "Figure 2. x", 12.0, 1), (1, 1, "para", "Big", 17.0, 1), (1, 2, "para", "small print", 9.0, 1), (1, 3, "para", "body", 12.0, 9), (1, 4, "para", "xii", 12.0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, kind string, text string, size double, n_lines int")
    found = R.refined(df, spark.createDataFrame([(1, 12.0)], "doc_id long, body_size double")).orderBy("seq").collect()
    assert [(r["kind"], r["level"]) for r in found] == [("caption", None), ("heading", 1), ("note", None), ("para", None), ("para", None)]
    assert R.without_page_numbers(df).count() == 4
    items_ = [(1, 0, k, s, 10.0, x, x + 5, y) for k, (s, x, y) in enumerate((("b", 20.0, 50.0), ("a", 5.0, 51.0), ("c", 5.0, 20.0), (" ", 0.0, 80.0)))]
    rows = R.page_lines(spark.createDataFrame(items_, "doc_id long, page int, seq int, str string, size double, x0 double, x1 double, y double")).orderBy("seq").collect()
    assert [r["text"] for r in rows] == ["c", "ab"] and rows[1]["y_top"] == 50 - 8.5


def test_crops_and_builds_with_pictures(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (396, 306, 3), dtype=np.uint8)
    assert (G.png_pixels(G.png(image)) == image).all()
    assert (G.cut_out(image, [20.0, 40.0, 120.0, 100.0], 0.5) == image[20:50, 10:60]).all()
    edge = G.cut_out(image, [600.0, 780.0, 620.0, 800.0], 0.5)  # beyond the page all is white
    assert edge.shape == (10, 10, 3) and (edge[6:] == 255).all() and (edge[:, 6:] == 255).all() and (edge[:6, :6] == image[390:, 300:]).all()
    assert G.cut_out(image, [0.0, 0.0, 600.0, 300.0], 0.5, 100).shape == (50, 100, 3) and G.cut_out(image, [0.0, 0.0, 1.0, 1.0], 0.5).shape == (4, 4, 3)
    rasters = spark.createDataFrame([(1, 0, 306, 396, bytearray(image.tobytes()))], "doc_id long, page int, w int, h int, rgb binary")
    boxes = spark.createDataFrame([(1, 0, 5, 20.0, 40.0, 120.4, 100.0), (1, 0, 6, 0.0, 0.0, 10.0, 10.0), (2, 0, 1, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, block_id long, x0 double, y0 double, x1 double, y1 double")
    cut = G.crops(rasters, boxes).orderBy("block_id")
    rows = cut.collect()
    assert [(r["block_id"], r["w"], r["h"]) for r in rows] == [(5, 100, 60), (6, 10, 10)] and (G.png_pixels(rows[0]["image"]) == image[20:50, 10:60]).all()
    found = spark.createDataFrame([(1, 5, "graphic", 1, None, "", None, 20.0, 40.0, 120.4, 100.0), (1, 7, "para", 1, None, "x", None, None, None, None, None)], "doc_id long, block_id long, kind string, page int, level int, text string, zh string, x0 double, y0 double, x1 double, y1 double")
    made = json.loads(script.document(found, spark.createDataFrame([(1, "file", "f.pdf")], "doc_id long, key string, value string"), 7, cut).first()["json"])
    assert made["blocks"][0]["img"].startswith("data:image/png;base64,") and made["blocks"][0]["w"] == 100 and "img" not in made["blocks"][1]


def test_page_census(spark):
    a = spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "doc_id long, page int")
    drawn = spark.createDataFrame([(1, 1, 5.0, 9.0)] * 41, "doc_id long, page int, y0 double, y1 double")
    rows = items.drawing_census(a, drawn, a.limit(0)).orderBy("page").collect()
    assert [(r["texts"], r["drawings"], r["images"], r["likely_figures"]) for r in rows] == [(2, 0, 0, False), (1, 41, 0, True)]


def test_markdown(spark):
    text = "# T & U\n- a **b**\n- `cd`\n1. one\n\np *e* $x_*y*$ and\n$$z$$\n$5 open"
    to_html = lambda t: spark.createDataFrame([(t,)], "t string").select(markdown_html("t")).first()[0]
    assert to_html(text) == "<h3>T &amp; U</h3><ul><li>a <strong>b</strong></li><li><code>cd</code></li></ul><ol><li>one</li></ol><p>p <em>e</em> $x_*y*$ and</p><p>$$z$$</p><p>$5 open</p>"
    assert to_html("") == "" and to_html(None) is None and to_html("\ue000 \ue001 $a<b$ \ue000\ue001") == "<p>\ue000 \ue001 $a&lt;b$ \ue000\ue001</p>"
    assert to_html("- a\n\n- b\n2) c") == "<ul><li>a</li></ul><ul><li>b</li></ul><ol><li>c</li></ol>"
    assert to_html("p\n  + x `y *z*` **b *c* d**\n#### H\n##### five") == "<p>p</p><ul><li>x <code>y <em>z</em></code> **b <em>c</em> d**</li></ul><h3>H</h3><p>##### five</p>"
    assert to_html("\\(a\nb\\) \\[c\\] $$d\n\ne$$") == "<p>$a\nb$ $$c$$ $$d\n\ne$$</p>"


def test_client_against_a_server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, status, body, kind="application/json"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):
            self.answer(200, json.dumps({"data": [{"id": "b"}, {"id": "a"}]}))

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            said = body["messages"][-1]["content"]
            if said == "html":
                self.answer(200, "<!doctype html><p>")
            elif said == "fail":
                self.answer(401, json.dumps({"error": {"message": "no key"}}))
            elif body.get("stream"):
                self.answer(200, "".join(f'data: {{"choices":[{{"delta":{{"content":"{c}"}}}}]}}\n\n' for c in "abc") + "data: [DONE]\n")
            else:
                self.answer(200, json.dumps({"choices": [{"message": {"content": " yes "}}]}))

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = C.ChatClient(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "k", "m")
        assert c("sys", "hello") == "yes" and c.models() == ["a", "b"] and "".join(c.stream([{"role": "user", "content": "x"}])) == "abc"
        assert c.reader("read")(b"png") == "yes" and seen[-1]["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
        assert c.probe()["ok"] and c.probe()["reply"] == "yes" and c.sees() and seen[-1]["max_tokens"] == 16
        with pytest.raises(C.ServiceError, match="web page"):
            c("s", "html")
        with pytest.raises(C.ServiceError, match="401: no key"):
            c("s", "fail")
    finally:
        server.shutdown()
    assert not c.probe()["ok"] and not c.sees()  # nothing answers any more
    with pytest.raises(C.ServiceError):
        C.address("ftp://x")
    assert C.engine("auto", True) == "model" and C.engine("auto", False) == C.engine("local", True) == "local"


def test_layout_overlay():
    assert Layout().overlaid({"dpi": 300.0, "unknown": 1, "line_tol": None}) == Layout(dpi=300.0)
