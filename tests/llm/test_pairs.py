"""Exact and near duplicates, and components, against brute force."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import components, exact_dedup, near_dedup, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def near_groups(docs):
    sets = [(d, shingle_set(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(parent, a), find(parent, b)))
                parent[q] = p
    return {d: (len(x), find(parent, d), find(parent, d) == d) for d, x in sets}


def family(rng, n, words=120, edits=6):
    base = [f"w{rng.integers(5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.integers(0, edits)):
            own[rng.integers(words)] = f"x{rng.integers(5000)}"
        yield " ".join(own)


def test_near_groups_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = [t for size in (1, 2, 3, 8, 40, 5, 1) for t in family(rng, size)] + ["", None, "a b", "A  b", "a b c"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = near_groups(docs)
    for block, bucket in ((near_dedup.BLOCK, near_dedup.BUCKET), (400, 4)):  # in one block, and in many pairs of blocks
        rows = near_dedup.groups(df, block, bucket=bucket).collect()
        assert {r["d"]: (r["n"], r["root_d"], r["d"] == r["root_d"]) for r in rows} == want


def test_near_digest_and_kept_rows(spark, odd, none):
    rows = near_dedup.digest(odd).collect()
    assert len(rows) == 16  # a row for each row, repeated ones included
    by = {(r["doc_id"], r["n_shingles"]): r for r in rows}
    assert by[1, 12]["kept"] and by[1, 12]["component_id"] == 1 and not by[3, 12]["kept"] and by[None, 12]["component_id"] == 1
    assert by[4, 0]["kept"] and by[5, 0]["kept"] and by[None, 0]["component_id"] is None
    assert by[9, 1]["component_id"] == by[10, 1]["component_id"] == 9
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    kept = near_dedup.kept_rows(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert near_dedup.digest(none).count() == near_dedup.kept_rows(none).count() == 0


def test_shingles_are_hashed_as_words_are_read():
    texts = ["The quick  Brown fox jumps over\tit", "", " \n", "ÄÖ a b c d e ÄÖ a b c d e", "x"]
    raw = [t.encode() for t in texts]
    got = shingles.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts]
    same = [t.encode() for t in ("a B c", "A b C", "a b c d")]
    one, two, three = shingles.shingle_sets(np.frombuffer(b"".join(same), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in same])]))
    assert one.tolist() == two.tolist() != three.tolist()


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)]))
    x, y = near_dedup.minima([a, b])
    assert abs((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, pairs):
    edges = spark.createDataFrame([(max(p), min(p)) for p in pairs], "a long, b long")
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        p, q = sorted((find(parent, a), find(parent, b)))
        parent[q] = p
    want = {x: find(parent, x) for x in parent if find(parent, x) != x}
    assert {r["a"]: r["root"] for r in components.components(edges).collect()} == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(200)]
    star = [(1000 + i, 999) for i in range(1, 3000)]
    rows = components.components(spark.createDataFrame(path + star, "a long, b long")).collect()
    assert {r["root"] for r in rows if r["a"] <= 200} == {0} and {r["root"] for r in rows if r["a"] > 999} == {999} and len(rows) == 200 + 2999


def test_a_hash_is_the_sum_of_shifted_chunk_hashes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, exact_dedup.CHUNK - 1, exact_dedup.CHUNK, exact_dedup.CHUNK + 1, 3 * exact_dedup.CHUNK + 7):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        want = []
        for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True):
            h = 0
            for i in range(0, n, 2):
                h = (h * b + int.from_bytes(data[i : i + 2].ljust(2, b"\0"), "little")) % p
            want.append(h)
        assert list(exact_dedup.fingerprint(data)) == want


@pytest.mark.parametrize("huge", [exact_dedup.HUGE, 64])
def test_exact_groups(spark, odd, none, huge):
    rows = [r for r in exact_dedup.duplicates(odd, huge).collect()]
    assert len(rows) == 15
    same = [r for r in rows if r["group_size"] == 4 and r["members"] == 3 and r["n_bytes"]]  # one of the three stands twice
    assert {r["doc_id"] for r in same} == {1, 2, None} and {r["keep_id"] for r in same} == {2}
    assert {r["keep_id"] for r in rows if r["doc_id"] in (4, 5)} == {5}  # a null text is an empty one
    assert [r["group_size"] for r in rows if r["doc_id"] in (3, 7, 8, 9, 10)] == [1] * 5
    assert exact_dedup.duplicates(none).count() == 0


def test_exact_kept_rows(odd, none):
    kept = exact_dedup.kept_rows(odd)
    texts = [r["text"] or "" for r in kept.collect()]
    assert kept.columns == odd.columns and len(texts) == len(set(texts)) == 11
    assert exact_dedup.kept_rows(none).count() == 0


def test_collided_fingerprints_are_told_apart(spark, monkeypatch):
    """All texts of a length collide: rounds of comparison must still find the classes."""
    docs = spark.createDataFrame([(i, f"text{i % 3}") for i in range(30)], "doc_id long, text string")
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d, huge: real(d, huge).withColumns({"fp1": F.lit(1).cast("long"), "fp2": F.lit(1).cast("long")}))
    rows = exact_dedup.duplicates(docs).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == {i: (27 + i % 3, 10) for i in range(30)}


def test_sets_of_one_very_long_text_and_of_many():
    """64 MB in one text, and a batch of many texts, are hashed in slices; the memory beside the hashes stays small."""
    import tracemalloc

    line = " ".join(f"w{i}" for i in range(200)) + "\n"
    long = (line * ((64 << 20) // len(line) + 1)).encode()
    tracemalloc.start()
    (got,) = shingles.shingle_sets(np.frombuffer(long, np.uint8), np.array([0, len(long)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 200 and peak < 10 * len(long)  # a sixth of the bytes are words' beginnings: 8 bytes each, a few times
    many = [f"{i} ".encode() + line.encode() * 4 for i in range(1000)]
    data, offsets = np.frombuffer(b"".join(many), np.uint8), np.concatenate([[0], np.cumsum([len(m) for m in many])])
    tracemalloc.start()
    sets = shingles.shingle_sets(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(s) for s in sets] == [201] * 1000 and peak < 10 * len(data)
    assert near_dedup.minima([got, sets[0]]).shape == (2, near_dedup.HASHES)


@pytest.mark.parametrize("size", [3, 50])
def test_words_are_hashed_alike_in_any_slices(monkeypatch, size):
    texts = [b"one two Three", b"", b"four", b" a-very-long-word-that-goes-over-slices " * 9, b"four", b"x" * 120]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want, n = shingles.word_hashes(data, offsets)
    monkeypatch.setattr(shingles, "SLICE", size)
    got, m = shingles.word_hashes(data, offsets)
    assert got.tolist() == want.tolist() and n.tolist() == m.tolist() == [3, 0, 1, 9, 1, 1]


def test_long_sets_have_the_signature_of_their_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5, 3000, 1, 700, 40)]
    want = near_dedup.minima(sets)
    monkeypatch.setattr(near_dedup, "CACHED", 64)
    assert (near_dedup.minima(sets) == want).all()


def test_the_least_similarity_of_links_is_a_parameter(spark):
    a = [f"a{i}" for i in range(104)]
    b = [*a[:92], *(f"b{i}" for i in range(12))]  # 88 of 112 shingles: 0.786; one word more in common makes 0.805
    c = [*a[:93], *(f"c{i}" for i in range(11))]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    roots = lambda link: {r["doc_id"]: r["component_id"] for r in near_dedup.digest(docs, link).collect()}
    x, y, z = (shingle_set(" ".join(t)) for t in (a, b, c))
    assert 0.80 <= len(x & z) / len(x | z) < 0.85 and len(x & y) / len(x | y) < 0.80
    assert roots(near_dedup.LINK) == {1: 1, 2: 2, 3: 3} and roots(near_dedup.NEAR) == {1: 1, 2: 2, 3: 1}


def test_exact_digest_is_its_sql(spark, odd):
    """Repeated rows count, as in the SQL; so do those that nothing else equals."""
    import duckdb

    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "alone"), (50, "alone"), (51, None), (51, "")], "doc_id long, text string"))
    documents = df.filter("doc_id is not null").toPandas()  # noqa: F841, read by DuckDB
    want = duckdb.sql(exact_dedup.ORACLE).fetchall()
    got = [tuple(r) for r in exact_dedup.digest(df.filter("doc_id is not null")).collect()]
    assert sorted(got) == sorted(want) and len(got) == 18


def test_copies_of_huge_texts_meet_chunk_by_chunk(spark, monkeypatch):
    """Texts of many chunks that differ in one of them, with colliding fingerprints, are told apart."""
    body = "".join(f"{i:07d} " for i in range(40_000))
    other = body[:200_000] + "x" + body[200_001:]
    assert len(body) > 4 * exact_dedup.CHUNK and len(body) == len(other)
    docs = spark.createDataFrame([(i, other if i in (2, 4) else body) for i in range(6)], "doc_id long, text string")
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d, huge: real(d, huge).withColumns({"fp1": F.lit(1).cast("long"), "fp2": F.lit(1).cast("long")}))
    rows = exact_dedup.duplicates(docs, 1000).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == {i: (4, 2) if i in (2, 4) else (5, 4) for i in range(6)}


def test_rows_that_agree_are_tied_across_batches():
    """Groups of any size, cut by batches anywhere, against all pairs."""
    import pyarrow as pa

    rng, rows = np.random.default_rng(12), []
    for family in range(60):
        n = int(rng.choice([2, 2, 3, 8, 20]))
        bases = rng.integers(0, 256, (3, near_dedup.HASHES), dtype=np.uint8)
        for _ in range(n):
            own = bases[rng.integers(3)].copy()
            own[rng.permutation(near_dedup.HASHES)[: rng.integers(0, 60)]] = rng.integers(0, 256)
            rows.append((family, int(rng.integers(10**6)), own))
    least = near_dedup.signed_share(85)
    want = set()
    for family in range(60):
        group = [r for r in rows if r[0] == family]
        parent = {r[1]: r[1] for r in group}
        for k, (_, a, x) in enumerate(group):
            for _, b, y in group[k + 1 :]:
                if (x == y).mean() >= least:
                    p, q = sorted((find(parent, a), find(parent, b)))
                    parent[q] = p
        want |= {(x, find(parent, x)) for x in parent if find(parent, x) != x}
    columns = ["family", "i", "j", "id", "block", "joined"]
    zero = [0] * len(rows)
    table = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in ([r[0] for r in rows], zero, zero, [r[1] for r in rows], zero, [r[1] for r in rows])), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=[*columns, "payload"])
    for size in (1, 7, 50, 1000):
        batches = [table.slice(k, size) for k in range(0, len(rows), size)]
        got = {pair for b in near_dedup._agree(85)(iter(batches)) for pair in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)}
        assert got == want and len(want) > 50
