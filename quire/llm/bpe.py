"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round finds each word's adjacent pair of lowest rank by
binary search over sorted pair keys, merges all of its occurrences in all words at once, and looks up anew
only the pairs that changed. Words whose pairs are not in the table are done and leave the array. A very long unbroken word
is merged by itself: its places are kept by the rank of their pair, so that a round costs what it merges.

Defined results
---------------
* A null text counts as empty and has no tokens. Special tokens' strings in a text become their ids,
  as in the tokenizers library without encode_special_tokens.
* Ids beyond the vocabulary raise an error on decoding; bytes that are not UTF-8 decode to U+FFFD.
* Every row gives a row: repeated rows, null or equal ids included. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import tune
from quire.llm.pretokens import Memo

#: Words in one flat array; more leave the processor's cache.
BULK = 20_000
NONE = np.int32(np.iinfo(np.int32).max)
#: Bytes beyond which a word is merged by itself.
LONG = 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """A few MB, whatever the corpus: what a worker needs to encode and decode."""

    of_byte: np.ndarray  # id of each single byte
    keys: np.ndarray  # sorted: left id << 32 | right id
    ranks: np.ndarray  # of keys
    merged: np.ndarray  # id made by the merge of each rank
    token: dict[int, bytes]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        return cls(np.array([vocab[c] for c in letters], np.int64), keys[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in pairs], np.int64), token, special)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo = Memo(self.encode_words, vocabulary.special)
        size = max(vocabulary.token) + 1
        self.token = [vocabulary.token.get(i) for i in range(size)]
        self.decimal = [b"%d," % i for i in range(size)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.ranks[at], NONE)

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        ids = self.v.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        which = np.arange(len(raw))  # the words still in the array; ids holds size[k] symbols of word which[k], one after the other
        if (alone := size > LONG).any():
            start = np.cumsum(size) - size
            for k in np.flatnonzero(alone):
                out[k] = self.merge_long(ids[start[k] : start[k] + size[k]])
            ids, which, size = ids[np.repeat(~alone, size)], which[~alone], size[~alone]
        if not size.all():
            which, size = which[size > 0], size[size > 0]
        rank = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = NONE  # a word's last symbol has no right neighbour
        while len(which):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            if (done := least == NONE).any():
                for k in np.flatnonzero(done):
                    out[which[k]] = ids[start[k] : start[k] + size[k]]
                stay = np.repeat(~done, size)
                ids, rank, which, size, least = ids[stay], rank[stay], which[~done], size[~done], least[~done]
                if not len(which):
                    break
            word = np.repeat(np.arange(len(which)), size)
            at = np.flatnonzero(rank == least[word])
            # in a run of overlapping occurrences (aaa) every other one merges, from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            ids[at] = self.v.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            size = size - np.bincount(word[at], minlength=len(size))
            at = at - np.arange(len(at))  # their places once the right halves are gone
            ids, rank = ids[keep], rank[keep]
            end = np.cumsum(size) - 1
            look = np.unique(np.concatenate([at, at[at > 0] - 1]))
            is_end = np.zeros(len(ids), bool)
            is_end[end] = True
            look = look[~is_end[look]]
            rank[look] = self.rank(ids[look], ids[look + 1])
            rank[end] = NONE
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One word's merges: symbols stay where they are, linked to their neighbours; a heap has the ranks that some pair has."""
        n, ids = len(ids), ids.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, gone = np.full(n, NONE, np.int32), np.zeros(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Look up the pairs that start at these places, and keep the places by rank."""
            right = after[at]
            inner = right < n
            rank[at] = NONE
            rank[at[inner]] = self.rank(ids[at[inner]], ids[right[inner]])
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for k, some in zip(rank[at[cuts]].tolist(), np.split(at, cuts[1:]), strict=False):
                if k not in places:
                    places[k] = []
                    heapq.heappush(heap, k)
                places[k].append(some)

        note(np.arange(n))
        while heap:
            k = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(k)))
            at = at[rank[at] == k]  # the others have been merged with something else
            if not len(at):
                continue
            # in a run of overlapping occurrences (aaa) every other one merges, from the left
            run = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            right = after[at]
            ids[at], gone[right], rank[right] = self.v.merged[k], True, NONE
            after[at] = after[right]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            note(np.unique(np.concatenate([at, left[left >= 0]])))
        return ids[~gone]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(words), BULK):
            out += self.merge_words(words[i : i + BULK])
        return np.concatenate(out).astype("<u4"), np.array([len(x) for x in out])

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        ids, counts = self.memo.encode(texts, end)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_of(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary, kept with its memory from batch to batch."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast and the digest of its contents, by which workers know it."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = hashlib.sha256(pickle.dumps(value)).hexdigest()

    @property
    def value(self):
        return self.broadcast.value


def list_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the tokens of each whole text."""
    tune(docs.sparkSession)
    shared = _Shared(docs.sparkSession, Vocabulary.load(path))
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), list_column(*codec.memo.encode([t or "" for t in b.column("text").to_pylist()]))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts of ids."""
    tune(encoded.sparkSession)
    shared = _Shared(encoded.sparkSession, Vocabulary.load(path))
    ids = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            texts = [codec.decode(np.asarray(x.values, np.int64)) if x.is_valid else "" for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids}, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, encoding and decoding each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    tune(docs.sparkSession)
    shared = _Shared(docs.sparkSession, Vocabulary.load(path))
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            encoded = codec.encode([t or "" for t in b.column("text").to_pylist()])
            listed = [hashlib.sha256(b"".join(map(codec.decimal.__getitem__, x.tolist()))[:-1]).hexdigest() for x in encoded]
            decoded = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in encoded]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in encoded], pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_tokens long, ids_sha256 string, decoded_sha256 string")
