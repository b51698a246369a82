"""The pipeline against plain steps over the same rows, and its odd cases."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_pairs import shingle_set
from test_rest import slow_quality, water
from tokenizers import Tokenizer

from quire.llm import labelled, near_dedup, quality
from quire.llm.common import settle

SF = "/root/testdata/sf0.001"


def by_hand(rows, model):
    """(doc_id, ids) of the pipeline's last rows: judged, told apart, thinned, mixed and encoded one document after another."""
    rows = [r for r in rows if slow_quality(r["text"] or "", model) >= quality.THRESHOLD]
    last = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        last[r["text"] or ""] = r
    rows = sorted(last.values(), key=lambda r: r["doc_id"])
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    group = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= near_dedup.NEAR * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len([w for w in (r["text"] or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w])
    goal, out = water(sizes, 1.5, 2), []
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        rate = goal[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        draw = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        found = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        out += [(r["doc_id"], len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out)


def test_pipeline_is_what_plain_steps_give(spark):
    import corpus_pipeline as p

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(labelled.sample(docs, labels, "quality", quality.SAMPLE))
    want = by_hand(docs.collect(), model)
    got = sorted(tuple(r) for r in p.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want and len(want) > 100 and len({w[0] for w in want}) < len(want)  # some documents stand twice


def test_stages_take_odd_rows(spark, odd, odd_labels, none, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns and no rows at all go through every stage."""
    import corpus_pipeline as p

    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, none):
        docs = rows
        for name, stage in p.STAGES[:-1]:
            before, docs = docs, settle(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == rows.columns
            if name != "mixing":
                assert docs.exceptAll(before).count() == 0
        assert p.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert [name for name, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]


@pytest.mark.parametrize("link", [near_dedup.LINK, near_dedup.NEAR])
def test_recall_of_links_at_the_threshold(spark, link):
    """Pairs that just reach the least similarity: every one must be found."""
    import numpy as np

    rng, rows = np.random.default_rng(link), []
    for k in range(400):
        base = [f"w{rng.integers(10**6)}" for _ in range(204)]  # 200 shingles
        for cut in range(200, 0, -1):  # a shared beginning of `cut` shingles, another end
            if 100 * (cut - 1) < link * (400 - cut + 1):
                break
        other = base[: cut + 4] + [f"x{rng.integers(10**6)}" for _ in range(200 - cut)]
        x, y = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        assert link <= 100 * len(x & y) / len(x | y) < link + 2
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = near_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), link)
    assert got.filter("component_id = doc_id - doc_id % 2").count() == 800 and got.filter(F.col("kept")).count() == 400
