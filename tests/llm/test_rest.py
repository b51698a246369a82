"""Top-k search, WARC, classifiers, mixing and the pipeline."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import labelled, mixing, quality, topk, toxicity, warc
from quire.llm.common import held_out, numbered, settle

SF = "/root/testdata/sf0.001"


# --- search ---


def brute(rows, k):
    out = []
    for n, (q, a) in enumerate(rows):
        if q % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(rows) if m != n and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def whole(v):
    return [int(np.floor(x * 1024)) for x in v]


@pytest.mark.parametrize("lane", [topk.LANE, 3000])
def test_search_is_exact(spark, monkeypatch, lane):
    monkeypatch.setattr(topk, "LANE", lane)
    monkeypatch.setattr(topk, "BOUNDED", 500)
    rng = np.random.default_rng(3)
    vectors = [(int(i), rng.normal(size=20).tolist()) for i in range(0, 1500, 5)]
    vectors += [(5001 + i, vectors[0][1]) for i in range(40)] + [(6000, vectors[0][1]), (7000, [1.0, 2.0]), (7001, [3.0, 1.0]), (7100, [])]
    vectors += [(300, vectors[7][1]), (300, vectors[60][1]), (vectors[3][0], vectors[3][1])]  # repeated ids: queries and candidates of their own
    vectors += [(int(i), (rng.normal(size=20) * 4e5).tolist()) for i in range(9000, 9300, 20)]
    odd = [(8000, None), (8001, [1.0, None]), (8002, [float("nan"), 1.0]), (8003, [float("inf")]), (None, [1.0] * 20)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors + odd], "vec_id long, embedding array<double>, score long, row int").repartition(5)
    got = sorted(tuple(r) for r in topk.digest(df).collect())
    assert got == brute([(i, whole(v)) for i, v in vectors], 10)
    assert topk.digest(df.limit(0)).count() == 0


def test_large_components_are_scored_exactly_or_not_at_all(spark):
    """Sums that leave the longs on the way, components that are no longs themselves, and scores that are none."""
    rows = [(0, [3e6, -3e6, 1.0]), (1, [3e6, 3e6, 2.0]), (2, [2e6, 2e6 - 1, 0.0]), (100, [0.0, 0.0, 5.0]), (3, [4e18, -4e18, 1.0]), (4, [1e17, 0.5, 1.0])]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    some = [r for r in rows if r[0] != 3]
    safe = [r for r in some if r[0] != 4]
    assert sorted(tuple(r) for r in topk.digest(make(safe)).collect()) == brute([(i, whole(v)) for i, v in safe], 10)
    wide = [r for r in rows if r[0] not in (0, 1, 2)]  # 100 meets components beyond the longs, with zeros
    assert sorted(tuple(r) for r in topk.digest(make(wide)).collect()) == brute([(i, whole(v)) for i, v in wide], 10)
    with pytest.raises(Exception, match="is no long"):
        topk.digest(make(some)).collect()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(30, 64)) * 100, rng.normal(size=(50, 64)) * 100
    exact = q @ x.T
    last = None
    for s in topk.SEGMENTS:
        bound = topk.describe(q, s) @ topk.describe(x, s).T
        assert (bound >= exact - 1e-6).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound


# --- WARC ---


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (5, "u", None), (None, "u", big), (0, "u", big), (0, "u", big), (9, "u", "é" * 300_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_digest int").repartition(3)


def test_warc_round_trip(spark, pages, tmp_path):
    monolithic = warc.write(pages, str(tmp_path))
    members = warc.normalise(monolithic, str(tmp_path))
    assert members.agg(F.sum("records")).first()[0] == 10
    rows = warc.read(members).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["record_type"] == ("revisit" if r["page_id"] in (1, 2) or (r["page_id"] is None) else "response")
        assert r["refers_to"] == (0 if r["record_type"] == "revisit" else None)
    nine = next(r for r in rows if r["page_id"] == 9)
    assert nine["payload_bytes"] == 600_000 and nine["payload_digest"] == hashlib.sha256(("é" * 300_000).encode()).hexdigest()
    assert next(r for r in rows if r["page_id"] == 2)["url"] == "http://b%0D%0AX: y"
    ids = [r["id"] for r in warc.index(members).collect()]
    assert len(set(ids)) == len(ids) == 10  # rows that repeat a page and its payload too
    for path in [r["path"] for r in members.collect()]:
        raw = open(path, "rb").read()
        entries = [eval(x) for x in open(path + ".idx").read().replace("null", "None").splitlines()]
        for e in entries:  # each member stands alone
            assert gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
    assert warc.digest(pages.limit(0)).count() == 0


def test_normaliser_reads_what_is_normalised_already():
    records = [warc.record(i, "u", b"p" * i, "d", i, None) for i in range(5)]
    out = []
    for source in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        sink = io.BytesIO()
        entries = list(warc.rewrite(io.BytesIO(source), sink, "f"))
        out.append(b"".join(gzip.decompress(sink.getvalue()[e["offset"] : e["offset"] + e["length"]]) for e in entries))
        assert len(entries) == 5
    assert out[0] == out[1] == b"".join(records)
    with pytest.raises(ValueError):
        list(warc.rewrite(io.BytesIO(gzip.compress(records[4][:-8])), io.BytesIO(), "f"))


# --- classifiers ---


def test_forward_backward_is_that_of_each_chain():
    rng = np.random.default_rng(0)
    lines = np.array([1, 3, 7, 1, 20])
    emit, tie = rng.normal(size=(lines.sum(), 2)) * 3, rng.normal(size=(2, 2))
    marginal, pair = quality.forward_backward(emit, tie, lines)
    at = 0
    for n in lines:
        e = np.exp(emit[at : at + n])
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = e[0]
        for k in range(1, n):
            a[k] = a[k - 1] @ np.exp(tie) * e[k]
        for k in range(n - 2, -1, -1):
            b[k] = np.exp(tie) @ (e[k + 1] * b[k + 1])
        g = a * b
        assert np.allclose(g / g.sum(axis=1, keepdims=True), marginal[at : at + n])
        for k in range(1, n):
            x = a[k - 1][:, None] * np.exp(tie) * e[k] * b[k]
            assert np.allclose(x / x.sum(), pair[at + k])
        at += n


def labelled_rows(spark, label):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, {r["doc_id"]: r[label] for r in labels.collect()}


def test_quality_on_held_out_documents(spark):
    docs, labels, truth = labelled_rows(spark, "quality")
    rows = [r for r in quality.digest(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_of_odd_rows(spark, odd, odd_labels, none):
    rows = quality.digest(odd, odd_labels).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    model = quality.learn(labelled.sample(odd, odd_labels, "quality", 100))
    assert quality.keep(odd, model).columns == odd.columns and quality.keep(odd, model, 0.0).count() == 16 and quality.keep(odd, model, 1.1).count() == 0
    assert quality.digest(none, odd_labels).count() == 0 and {r["score"] for r in quality.digest(odd, odd_labels.limit(0)).collect()} == {0.5}


def lines_told(text):
    """What a line's characters and words tell, counted one by one."""
    out = []
    for line in text.split("\n"):
        raw = line.encode()
        words = [w.lower() for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", raw)]
        n = lambda some: sum(c in some for c in raw)  # noqa: E731, B023
        upper, lower, digit, beyond = n(range(65, 91)), n(range(97, 123)), n(range(48, 58)), n(range(128, 256))
        plain, ends, bar, symbol, blank = n(b".,;:'\"?-()"), n(b".!?"), n(b"|"), n(b"!#$%&*+/<=>@[\\]^_`{}~"), n(b" \t\r\x0b\x0c")
        letters, whole, many = upper + lower + beyond / 2, max(len(raw), 1), max(len(words), 1)
        out.append([
            np.log1p(len(raw)), np.log1p(len(words)), letters / whole, upper / max(letters, 1), digit / whole, beyond / whole, plain / whole, (symbol / whole) ** 0.5, (bar / whole) ** 0.5, blank / whole, (ends / many) ** 0.5,
            min(letters / many, 20), len(set(words)) / many, float(raw[-1:] in (b".", b"!", b"?")), float(not raw), (symbol / many) ** 0.5,
        ])
    return out


def slow_quality(text, model):
    """A text's score by loops over its lines."""
    told = lines_told(text)
    rows = []
    for k, own in enumerate(told):
        before = told[k - 1] if k else [0.0] * len(own)
        after = told[k + 1] if k + 1 < len(told) else [0.0] * len(own)
        rows.append([*own, *before, *after, float(k == 0), float(k + 1 == len(told))])
    emit = [[sum((f - m) / s * w for f, m, s, w in zip(row, model.mean, model.scale, model.weight[:-1, y], strict=True)) + model.weight[-1, y] for y in (0, 1)] for row in rows]
    ahead, back = [[0.0, 0.0] for _ in rows], [[0.0, 0.0] for _ in rows]
    for k in range(len(rows)):
        for y in (0, 1):
            ahead[k][y] = emit[k][y] + (np.logaddexp(ahead[k - 1][0] + model.transition[0, y], ahead[k - 1][1] + model.transition[1, y]) if k else 0.0)
    for k in range(len(rows) - 2, -1, -1):
        for y in (0, 1):
            back[k][y] = np.logaddexp(*(model.transition[y, z] + emit[k + 1][z] + back[k + 1][z] for z in (0, 1)))
    good = [1 / (1 + np.exp(np.clip(a[0] + b[0] - a[1] - b[1], -500, 500))) for a, b in zip(ahead, back, strict=True)]
    weight = [len(line.encode()) + 1 for line in text.split("\n")]
    return sum(g * w for g, w in zip(good, weight, strict=True)) / sum(weight)


@pytest.fixture(scope="module")
def quality_model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, quality.learn(labelled.sample(docs, labels, "quality", quality.SAMPLE))


@pytest.mark.parametrize("at_once", [quality.AT_ONCE, 700])
def test_quality_is_that_of_loops_over_lines(quality_model, odd, monkeypatch, at_once):
    """Every document of a table, in groups and (at_once small) in stretches of lines; the odd texts too."""
    docs, _, model = quality_model
    monkeypatch.setattr(quality, "AT_ONCE", at_once)
    texts = [r["text"] or "" for r in docs.collect() if len(r["text"] or "") < 6000] + [r["text"] or "" for r in odd.collect() if len(r["text"] or "") < 6000] + ["\n", "\n\n\nx\n", "end.", "A"]
    raw = [t.encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    assert len(texts) > 100 and np.allclose(got, [slow_quality(t, model) for t in texts], atol=1e-9)


def test_quality_query_is_its_model(quality_model):
    docs, labels, model = quality_model
    some = docs.filter(F.length("text") < 4000)
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    found = {r["doc_id"]: r["score"] for r in quality.digest(docs, labels).collect()}
    assert all(abs(found[d] - slow_quality(t, model)) < 1e-9 for d, t in texts.items())
    kept = {r["doc_id"] for r in quality.keep(some, model).collect()}
    assert kept == {d for d, t in texts.items() if slow_quality(t, model) >= quality.THRESHOLD}


def test_quality_of_very_long_texts(quality_model):
    """64 MB of prose, of one line and of many empty lines, and a batch of many: memory beside the text stays small."""
    import tracemalloc

    model = quality_model[2]
    for unit, size, most in (("A line of words, as they stand. Another one!\n", 64, 60), ("word another ", 64, 400), ("\n", 1, 200)):
        data = np.frombuffer((unit * ((size << 20) // len(unit))).encode(), np.uint8)
        tracemalloc.start()
        (score,) = model.score(data, np.array([0, len(data)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0 <= score <= 1 and peak < most << 20
    many = np.frombuffer(("A line of words, as they stand.\n" * 100).encode() * 1000, np.uint8)
    tracemalloc.start()
    scores = model.score(many, np.arange(1001) * 3200)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20 and np.ptp(scores) < 1e-12
    tracemalloc.stop()


def test_gradients():
    net = toxicity.Network.new(0.5, {"aa": 1, "bbb": 2})
    words, label = [["aa", "bbb", "cde"], ["zz"], ["bbb", "q", "aa", "longerword"], []], np.array([1, 0, 1, 0])
    net.theta = {k: v.astype(np.float64) for k, v in net.theta.items()}
    slope = lambda: net.slopes(words, label, np.random.default_rng(0))
    _, g = slope()
    rng = np.random.default_rng(1)
    for k, v in net.theta.items():
        for i in rng.permutation(np.argwhere(np.abs(g[k]) > 1e-6))[:2]:
            i, keep = tuple(i), v[tuple(i)]
            v[i] = keep + 1e-3
            up = slope()[0]
            v[i] = keep - 1e-3
            down = slope()[0]
            v[i] = keep
            assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3 * max(0.1, abs(g[k][i])) + 1e-4


def slow_gru(rows, u, backward):
    """States of a gated recurrent layer over projected inputs, by loops."""
    size = u.shape[0]
    h, out = [0.0] * size, [None] * len(rows)
    for t in reversed(range(len(rows))) if backward else range(len(rows)):
        x, hu = rows[t], [sum(h[i] * u[i, j] for i in range(size)) for j in range(3 * size)]
        z = [1 / (1 + np.exp(-(x[j] + hu[j]))) for j in range(size)]
        r = [1 / (1 + np.exp(-(x[size + j] + hu[size + j]))) for j in range(size)]
        c = [np.tanh(x[2 * size + j] + r[j] * hu[2 * size + j]) for j in range(size)]
        h = out[t] = [c[j] + z[j] * (h[j] - c[j]) for j in range(size)]
    return out


def slow_toxicity(text, net):
    """A text's score: its words one by one, every window by itself."""
    t, inputs = net.theta, {}

    def read(word):
        if word not in inputs:
            letters = [t["chars"][ord(c) if ord(c) < 384 else 384 + ord(c) % (toxicity.CHARACTERS - 384)] for c in word]
            f = slow_gru([x @ t["cwf"] + t["cbf"] for x in letters], t["cuf"], False)[-1]
            b = slow_gru([x @ t["cwb"] + t["cbb"] for x in letters], t["cub"], True)[0]
            inputs[word] = np.concatenate([t["words"][net.known.get(word, 0)], f, b])
        return inputs[word]

    words = []
    for raw in text.split():
        w = raw.strip(toxicity.STRIP).lower()
        words += [w[i : i + toxicity.LETTERS] for i in range(0, len(w), toxicity.LETTERS)]
    starts = [0] if len(words) <= toxicity.WINDOW else [*range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE), len(words) - toxicity.WINDOW]
    found = []
    for s in starts:
        v = [read(w) for w in words[s : s + toxicity.WINDOW]]
        if not v:
            found.append(t["bias"][0])
            continue
        f, b = slow_gru([x @ t["wwf"] + t["wbf"] for x in v], t["wuf"], False), slow_gru([x @ t["wwb"] + t["wbb"] for x in v], t["wub"], True)
        states = [np.concatenate([x, y]) for x, y in zip(f, b, strict=True)]
        note = [float(h @ t["attend"][:, 0]) for h in states]
        weight = [np.exp(n - max(note)) for n in note]
        found.append(sum(w * float(h @ t["out"][:, 0]) for w, h in zip(weight, states, strict=True)) / sum(weight) + t["bias"][0])
    return 1 / (1 + np.exp(-max(found)))


def test_toxicity_is_that_of_loops_over_words(spark, odd, odd_labels):
    """The query's scores of a table's shorter documents and of odd texts, against loops."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 1500), spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.learn(labelled.sample(docs, labels, "toxic", toxicity.SAMPLE, toxicity.POSITIVE))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.digest(docs, labels).collect()
    some = sorted(rows, key=lambda r: r["doc_id"])[:25]
    assert len(rows) == len(texts) and all(abs(r["score"] - slow_toxicity(texts[r["doc_id"]], net)) < 1e-3 for r in some)
    strange = ["", "... !!", "x" * 100, "Word! (b) " + "\u00dc\u6587 " * 70, "a\u00a0b"]
    assert np.allclose(toxicity.Scorer(net).score(strange), [slow_toxicity(t, net) for t in strange], atol=1e-3)


def test_a_scorers_memory_is_bounded(monkeypatch):
    """Forms that are all marks, long words and forms of one word count too; scores stay what they were."""
    monkeypatch.setattr(toxicity, "MEMO", 100)
    net = toxicity.Network.new(0.5, {"b": 1})
    scorer, fresh = toxicity.Scorer(net), lambda t: toxicity.Scorer(net).score(t)
    for make in (lambda i: "#" * (i + 1), lambda i: "-" * i + "word", lambda i: f"{i:05d}" * 10):
        for k in range(12):
            texts = [make(30 * k + i) + " and b" for i in range(30)]
            assert np.allclose(scorer.score(texts), fresh(texts), atol=1e-6)
            assert max(scorer.used, len(scorer.raw), scorer.pieces) <= 100 + 30 * 4


def test_two_networks_in_one_session(spark):
    docs = spark.createDataFrame([(i, f"some words {i} b") for i in range(40)], "doc_id long, text string").repartition(4)
    nets = [toxicity.Network.new(0.5, {"b": 1}, seed) for seed in range(6)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for net in [*nets, *nets]:
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
        assert all(abs(got[d] - toxicity.Scorer(net).score([t])[0]) < 1e-6 for d, t in texts.items())


def test_samples_are_bounded_per_id_and_in_all(spark, monkeypatch):
    """An id that stands very often gives one row; labels without documents take no place; bytes are bounded."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:80]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids[:40]], "doc_id long, text string").unionByName(spark.range(5000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("again "), F.col("id").cast("string")).alias("text")))
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    assert len(labelled.sample(docs, labels, "quality", 60)) == 40
    assert len(labelled.sample(docs, labels, "quality", 20)) >= 15
    both = labelled.sample(docs, labels, "quality", 60, 10)
    assert sum(y for _, y in both) <= 10 and len(both) <= 60
    monkeypatch.setattr(labelled, "IN_ALL", 100)
    assert sum(len(t) for t, _ in labelled.sample(docs, labels, "quality", 60)) <= 100


def test_scorer_is_the_training_network():
    net = toxicity.Network.new(0.5, {"b": 1})
    texts = ["a b c", "", "x " * 200, "Word! (b) " + "y" * 90, "### ..."]
    scorer = toxicity.Scorer(net)
    got = scorer.score(texts)
    for text, s in zip(texts, got, strict=True):
        words = toxicity.cut_words(text)
        alone = max(toxicity.Scorer(net).window_scores([words[i : i + toxicity.WINDOW]])[0] for i in toxicity.window_starts(len(words)))
        assert abs(1 / (1 + np.exp(-alone)) - s) < 1e-5
    assert np.allclose(scorer.score(texts), got)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        starts = list(toxicity.window_starts(n))
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity(spark, odd, odd_labels, none):
    docs, labels, truth = labelled_rows(spark, "toxic")
    rows = [r for r in toxicity.digest(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.93
    rows = toxicity.digest(odd, odd_labels).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.digest(none, odd_labels).count() == 0


def test_samples_leave_held_out_rows_alone(spark, odd, odd_labels):
    assert odd.limit(1).select(held_out(F.lit(None).cast("long"))).first()[0]
    ids = [r["doc_id"] for r in odd.filter(held_out(F.col("doc_id"))).collect()]
    texts = {t for t, _ in labelled.sample(odd.filter("text is not null"), odd_labels, "quality", 100)}
    assert not texts & {r["text"] for r in odd.collect() if r["doc_id"] in ids and r["doc_id"] not in (1, 2, None)}
    assert len(labelled.sample(odd, odd_labels, "quality", 1)) <= 2


# --- mixing ---


def water(sizes, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, capped = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        goal = {s: weight[s] * left / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if goal[s] > cap * sizes[s]}
        if not over:
            return goal | {s: cap * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark, odd, none):
    rows = mixing.digest(odd).collect()
    assert len(rows) == 16
    sizes = {}
    for r in odd.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    want = water(sizes, 1.5, 2)
    got = {(r["source"]): r["target"] for r in mixing.mix(odd).select("source", "target").distinct().collect()}
    assert got == pytest.approx(want) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.digest(odd.repartition(7)).collect()))
    emitted = mixing.emit(odd)
    assert emitted.columns == odd.columns and emitted.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.digest(none).count() == mixing.emit(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 4 < 2, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    rows = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.03 for r in rows)


# --- shared ---


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    rows = numbered(df, [F.col("x")]).collect()
    assert all(r["x"] == r["position"] for r in rows) and len(rows) == 1000
    assert numbered(df.limit(0), [F.col("x")]).count() == 0


def test_settled_tables_are_in_the_shared_folder(spark):
    t = settle(spark.range(3), "t")
    assert t.count() == 3 and spark.conf.get("spark.checkpoint.dir") in t.inputFiles()[0]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs, sf = spark.read.parquet(f"{SF}/documents.parquet"), SF
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.5 * counts[0]
    assert p.STAGES[-1][1](spark, docs, sf).count() == counts[4] == p.run(spark, sf).count()
    texts = [r["text"] for r in docs.select("text").distinct().collect()]
    assert docs.select("doc_id").distinct().count() == len(texts)  # one document of each group of copies
