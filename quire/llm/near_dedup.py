"""Near-duplicate detection by MinHash.

1. A document's set is its distinct SIZE-word shingles. HASHES universal hash functions give its minima, which
   are cut into BANDS bands. Documents of equal sets become one class, so exact copies cost nothing further.
2. Classes that share a band's hash meet in its bucket with a byte of each minimum. Those that agree in enough of them are
   tied; what shares a band by chance alone is not, so that chance does not chain texts together as the corpus grows.
   Components of the ties (alternating large-star and small-star) are the families in which links can be.
3. A family's texts meet. Pairs of fitting size whose signatures agree in enough minima are compared
   on their full sets, unless links found already join them.
   A large bucket or family is dealt into blocks, and a pair of blocks is a group of its own, so nothing unbounded
   meets. At first each block meets itself and the first block, which joins up copies of one text in work that grows as
   their number; pairs of blocks whose members are not all joined by then meet in a second round, so that no pair is left out.
4. Components of the links, again by alternating stars, are the near-duplicate groups.

Links have at least `link` hundredths of the union in common: LINK by the query's contract, NEAR by the general rule. A pair
that just does misses all bands with a probability below 3e-8 (LINK) or 7e-6 (NEAR), and falls short in signature with one
below 1e-6; more similar pairs with less.

Defined results
---------------
* Every row gives a row; rows repeating doc_id and text give equal ones, and kept_rows() keeps one of them.
* A text without words, or null, has an empty set and links with nothing.
* Documents are ordered by doc_id, null last, then by a hash of the text; a component's id is its least
  document's, and that document is kept.
* Sets are those of 64-bit hashes of their shingles. A link must hold under two independent families of hashes, so that a
  chance collision in one makes none. Texts are hashed in slices and long sets in pieces, so a text's length is bounded by
  its own size in memory (some 8 bytes for each of its bytes). An empty table gives an empty result.
* Only doc_id and text are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import flat_bytes, numbered, settle, tune
from quire.llm.components import components
from quire.llm.shingles import SECOND, mix, shingle_sets

BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Links have at least this many hundredths of the union in common: by the query's contract, and by the general rule for other uses.
LINK, NEAR = 85, 80
#: Shingles in a block of a family, and classes in a block of a bucket.
BLOCK, BUCKET = 1 << 15, 1 << 12
#: Shingles hashed at once: they stay in the processor's cache.
CACHED = 1 << 14
SEED = 20240229

_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIXED = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed_share(link: int) -> float:
    """The least share of equal minima for a pair to be compared on full sets: five deviations below its likely share."""
    return link / 100 - 5 * (link / 100 * (1 - link / 100) / HASHES) ** 0.5


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set (none empty): the minima of (a x + b) mod 2**64, upper half, x a shingle's upper half."""
    pieces = [s[k : k + CACHED] for s in sets for k in range(0, len(s), CACHED)]
    out = np.empty((len(pieces), HASHES), np.uint64)
    i = 0
    while i < len(pieces):
        j, size = i, 0
        while j < len(pieces) and (j == i or size + len(pieces[j]) <= CACHED):
            size += len(pieces[j])
            j += 1
        x = np.concatenate(pieces[i:j]) >> np.uint64(32)
        starts = np.cumsum([0, *map(len, pieces[i : j - 1])])
        y = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=y)
            np.add(y, _B[k], out=y)
            out[i:j, k] = np.minimum.reduceat(y, starts)
        i = j
    if len(pieces) > len(sets):  # long sets are in pieces
        out = np.minimum.reduceat(out, np.cumsum([0, *(-(-len(s) // CACHED) for s in sets[:-1])]), axis=0)
    return out >> np.uint64(32)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    return mix((rows * _MIXED).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(*flat_bytes(b.column("bytes")))
        full = [k for k, s in enumerate(sets) if len(s)]
        signatures = minima([sets[k] for k in full]) if full else np.zeros((0, HASHES), np.uint64)
        bands, low = band_hashes(signatures), signatures.astype(np.uint8)
        signed = [None] * len(sets)
        for k, row in zip(full, low, strict=True):
            signed[k] = row.tobytes()
        offsets = np.zeros(len(sets) + 1, np.int32)
        offsets[1:] = np.cumsum([BANDS * bool(len(s)) for s in sets])
        prints = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        yield pa.RecordBatch.from_arrays(
            [b.column("d"), b.column("u"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, prints), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1))), pa.array(signed, pa.binary())],
            names=["d", "u", "n", "s1", "s2", "bands", "signed"],
        )


#: Stands for a null doc_id: after any other.
LAST = (1 << 63) - 1
SET = ["n", "s1", "s2"]


def identified(docs: DataFrame) -> DataFrame:
    """d, u, text: a document's identity and its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text")).select("d", F.xxhash64("text").alias("u"), "text")


def alike(a: np.ndarray, b: np.ndarray, link: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= link * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], again: list[np.ndarray], blocks: np.ndarray, known: np.ndarray, cross: bool, link: int) -> np.ndarray:
    """A label for each set, equal where links join them: those known (equal numbers) and those found here.

    again: the sets by the second family of hashes. cross: only pairs of different blocks are compared.
    """
    size = np.array([len(s) for s in sets])
    signed = minima(sets).astype(np.uint32)
    least = signed_share(link)
    label = known.copy()
    places = np.arange(len(sets))
    for x in range(len(sets) - 1):
        fits = (places > x) & (label != label[x]) & (100 * np.minimum(size, size[x]) >= link * np.maximum(size, size[x]))
        if cross:
            fits &= blocks != blocks[x]
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        agree = (signed[near] == signed[x]).mean(axis=1)
        for y in near[agree >= least][np.argsort(-agree[agree >= least], kind="stable")]:
            if label[y] != label[x] and alike(sets[x], sets[y], link) and alike(again[x], again[y], link):
                label[label == label[y]] = label[x]
    return label


def _compare(link: int):
    """Rows arrive sorted by family and pair of blocks; holds one pair of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, blocks, known, sets, again = None, [], [], [], [], []

        def out() -> pa.RecordBatch:
            a, b = [], []
            if len(sets) > 1:
                before, node = np.array(known), np.array(ids)
                label = links(sets, again, np.array(blocks), before, at[1] != at[2], link)
                for k in np.unique(label):
                    if len(np.unique(before[label == k])) > 1:
                        group = np.sort(node[label == k])
                        a += group[1:].tolist()
                        b += [int(group[0])] * (len(group) - 1)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            nodes, block, joined = (batch.column(c).to_pylist() for c in ("id", "block", "joined"))
            data, offsets = flat_bytes(batch.column("payload"))
            got, got_again = shingle_sets(data, offsets), shingle_sets(data, offsets, SECOND)
            for k, key in enumerate(keys):
                if key != at:
                    if at is not None:
                        yield out()
                    at, ids, blocks, known, sets, again = key, [], [], [], [], []
                ids.append(nodes[k])
                blocks.append(block[k])
                known.append(joined[k])
                sets.append(got[k])
                again.append(got_again[k])
        if at is not None:
            yield out()

    return run


def tied(signed: np.ndarray, blocks: np.ndarray, known: np.ndarray, cross: bool, least: float) -> np.ndarray:
    """A label for each row of signatures' bytes, equal where rows that agree in the least share of them join them."""
    label = known.copy()
    for x in range(len(signed) - 1):
        other = label != label[x]
        if not other.any():
            break
        other[:x] = False
        if cross:
            other &= blocks != blocks[x]
        near = np.flatnonzero(other)
        for k in np.unique(label[near[(signed[near] == signed[x]).mean(axis=1) >= least]]):
            label[label == k] = label[x]
    return label


def _agree(link: int):
    """Rows arrive sorted by bucket and pair of blocks; holds one pair of blocks at a time, and one batch."""
    least, names = signed_share(link), ("family", "i", "j", "id", "block", "joined")

    def found(family, i, j, node, block, joined, signed) -> pa.RecordBatch:
        change = np.flatnonzero((family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        start = np.concatenate([[0], change])
        size = np.diff(start, append=len(family))
        two = start[(size == 2)]
        two = two[((i[two] == j[two]) | (block[two] != block[two + 1])) & (joined[two] != joined[two + 1])]
        two = two[(signed[two] == signed[two + 1]).mean(axis=1) >= least]
        a, b = [np.maximum(node[two], node[two + 1])], [np.minimum(node[two], node[two + 1])]
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = slice(at, at + n)
            label = tied(signed[own], block[own], joined[own], i[at] != j[at], least)
            for k in np.unique(label):
                members = np.flatnonzero(label == k)
                if len(np.unique(joined[own][members])) > 1:
                    group = np.sort(node[own][members])
                    a.append(group[1:])
                    b.append(np.full(len(group) - 1, group[0]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [*(np.asarray(batch.column(c)) for c in names), flat_bytes(batch.column("payload"))[0].reshape(-1, HASHES)]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            last = int(same.argmax())  # the last group may go on in the next batch
            if last:
                yield found(*(c[:last] for c in rows))
            held = [c[last:] for c in rows]
        if held is not None:
            yield found(*held)

    return run


def _met(rows: DataFrame, meet) -> DataFrame:
    """Links (a, b) among rows (family, i, j, block, id, joined, payload) of each pair of blocks."""
    key = ["family", "i", "j"]
    return rows.select(*key, "block", "id", "joined", "payload").repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, "a long, b long")


def joining_links(held: DataFrame, meet) -> DataFrame:
    """a, b: links that join up the members of groups. held: id, family (the group), blocks, block and payload; an id may be in many groups."""
    other = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    first = held.withColumn("other", F.explode(other)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "joined": F.col("id")})
    links_ = settle(_met(first, meet), "links")
    # what is left: pairs of later blocks whose members are not all in one component
    large = held.filter("blocks > 2 and block > 0").select("id", "family", "block")
    if not large.take(1):
        return links_
    joined = components(links_).select(F.col("a").alias("id"), F.col("root").alias("joined"))
    now = settle(large.join(joined, "id", "left").withColumn("joined", F.coalesce("joined", "id")), "joined")
    span = settle(now.groupBy("family", "block").agg(F.min("joined").alias("lo"), F.max("joined").alias("hi")), "spans")
    i, j = (span.select("family", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi")]) for k in "ij")
    apart = (F.col("lo_i") != F.col("hi_i")) | (F.col("lo_j") != F.col("hi_j")) | (F.col("lo_i") != F.col("lo_j"))
    left = i.join(j, "family").filter((F.col("block_i") < F.col("block_j")) & apart).select("family", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    sides = settle(left.withColumn("block", F.explode(F.array("i", "j"))), "sides")
    second = now.join(sides, ["family", "block"]).join(held.select("id", "family", "payload"), ["id", "family"])
    return links_.unionByName(_met(second, meet))


def groups(docs: DataFrame, block: int = BLOCK, link: int = LINK, bucket: int = BUCKET) -> DataFrame:
    """A row for each row of docs: d, u, n (size of its set), root_d, root_u (the least document of its component)."""
    tune(docs.sparkSession)
    texts = identified(docs)
    told = texts.select("d", "u", F.col("text").cast("binary").alias("bytes")).mapInArrow(_describe, "d long, u long, n long, s1 long, s2 long, bands array<long>, signed binary")
    told = settle(told, "sets")

    # classes of equal sets, numbered in the order of their least documents
    least = told.filter("n > 0").groupBy(*SET).agg(F.min(F.struct("d", "u")).alias("least"), F.first("bands").alias("bands"), F.first("signed").alias("signed"))
    classes = numbered(least.select(F.col("least.d").alias("d"), F.col("least.u").alias("u"), *SET, "bands", "signed"), [F.col("d"), F.col("u")], "id")

    # families: who shares a bucket and agrees
    banded = classes.select("id", F.explode("bands").alias("family"))
    buckets = settle(banded.groupBy("family").agg(F.count("*").alias("m")).filter("m > 1").select("family", F.ceil(F.col("m") / F.lit(bucket)).cast("int").alias("blocks")), "buckets")
    shared = settle(banded.join(buckets, "family"), "shared")  # numbers alone; signatures go only to those who share a bucket
    shared = shared.join(classes.select("id", F.col("signed").alias("payload")), "id")
    ties = joining_links(shared.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), _agree(link))
    stars = components(ties)
    family = settle(stars.select(F.col("a").alias("id"), F.col("root").alias("family")).unionByName(stars.select(F.col("root").alias("id"), F.col("root").alias("family")).distinct()), "families")

    # each family's texts meet, in pairs of blocks where they are many
    places = settle(classes.select("id", "d", "u", "n").join(family, "id"), "places")
    sizes = settle(places.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks")), "sizes")
    dealt = places.join(sizes, "family").select("id", "d", "u", "family", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    held = texts.withColumn("payload", F.col("text").cast("binary")).join(dealt, ["d", "u"]).dropDuplicates(["id"]).drop("d", "u", "text")
    joined = components(joining_links(settle(held, "held"), _compare(link)))

    # back to documents
    names = classes.select(F.col("id").alias("root"), F.col("d").alias("root_d"), F.col("u").alias("root_u"))
    roots = settle(joined.join(names, "root").select(F.col("a").alias("id"), "root_d", "root_u"), "roots")
    of_class = classes.select("id", *SET, "d", "u").join(roots, "id", "left").select(*SET, F.coalesce("root_d", "d").alias("root_d"), F.coalesce("root_u", "u").alias("root_u"))
    of_class = settle(of_class, "of_class")
    return told.select("d", "u", *SET).join(of_class, SET, "left").select("d", "u", "n", F.coalesce("root_d", "d").alias("root_d"), F.coalesce("root_u", "u").alias("root_u"))


def digest(docs: DataFrame, link: int = LINK) -> DataFrame:
    """The contract's columns: doc_id, n_shingles, component_id, kept."""
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return groups(docs, link=link).select(back("d").alias("doc_id"), F.col("n").alias("n_shingles"), back("root_d").alias("component_id"), (F.col("d") == F.col("root_d")).alias("kept"))


def kept_rows(docs: DataFrame, link: int = LINK) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of each group the least document, once."""
    keep = settle(groups(docs, link=link).filter((F.col("d") == F.col("root_d")) & (F.col("u") == F.col("root_u"))).select("d", "u").distinct(), "kept")
    d, u = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce("text", F.lit("")))
    whole = docs.select(d.alias("d"), u.alias("u"), F.struct(*docs.columns).alias("row"))
    return whole.join(keep, ["d", "u"]).dropDuplicates(["d", "u"]).select("row.*")
