"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are counts of its characters and words, seen beside
those of the lines around it; the chain's transitions tie neighbouring labels. Marginals come from
forward-backward, run for many documents at once: a step is a 2 x 2 matrix, a document's first step
has equal rows (which cuts the chain), and prefix products of all steps are found by doubling.
A document's score is the mean of its lines' marginals, weighted by their length.

Memory is bounded by the longest text's bytes, not by its lines: documents are scored in groups of AT_ONCE bytes, and one
beyond that goes through the chain in two passes over stretches of lines, which hand on the forward and backward messages.

The field learns from a bounded sample of SAMPLE labelled documents, each line taking its document's label.

Defined results
---------------
* A null text counts as empty. A text is one line at least; an empty one is scored by its features like any other.
* Without labelled documents of both kinds, every score is the share of label 1 among them, or 0.5 if there is none.
* Every row gives a row: repeated rows and null ids included. Only doc_id and text are read, and of the labels
  doc_id and the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import flat_bytes, held_out, tune
from quire.llm.labelled import sample
from quire.llm.shingles import SLICE, word_hashes

#: Labelled documents that the field learns from, at most.
SAMPLE = 2000
THRESHOLD = 0.3
STEPS = 200
RATE = 0.05
RIDGE = 1e-3


#: Bytes of text (a line counting as LINE of them besides) whose lines' features are held at once.
AT_ONCE, LINE = 1 << 20, 32
#: Words of a line counted for repeats at once; of more, those with equal low bits are counted together.
WORDS_AT_ONCE = 1 << 19
TOLD = 16

#: Classes of bytes; each byte has one.
CLASSES = ("upper", "lower", "digit", "beyond", "plain", "stop", "shout", "bar", "symbol", "blank")
_class = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate([range(65, 91), range(97, 123), range(48, 58), range(128, 256), b",;:'\"-()", b".?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b" \t\r\x0b\x0c"]):
    _class[list(_bytes)] = _k


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line of the texts starts and ends, and each text's number of lines (an empty text has one empty line)."""
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    lines = np.bincount(text_of_break, minlength=len(offsets) - 1) + 1
    first = np.cumsum(lines) - lines
    start = np.empty(lines.sum(), np.int64)
    inner = np.ones(len(start), bool)
    inner[first] = False
    start[first], start[inner] = offsets[:-1], breaks + 1
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[first + lines - 1] = offsets[1:]
    return start, end, lines


def _counts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each class each line has; lines are in order and don't overlap."""
    out = np.zeros((len(start), len(CLASSES) + 1), np.int64)
    for a in range(int(start[0]), int(end[-1]), SLICE):
        b = min(a + SLICE, int(end[-1]))
        i, j = np.searchsorted(end, a, side="right"), np.searchsorted(start, b)
        size = np.minimum(end[i:j], b) - np.maximum(start[i:j], a)
        at = np.repeat(np.maximum(start[i:j], a) - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = np.repeat(np.arange(j - i) * out.shape[1], size) + _class[data[at]]
        out[i:j] += np.bincount(key, minlength=(j - i) * out.shape[1]).reshape(j - i, out.shape[1])
    return out


def told_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What each line's own characters and words tell (lines, TOLD)."""
    size = end - start
    n = dict(zip(CLASSES, _counts(data, start, end)[:, : len(CLASSES)].T.astype(float), strict=True))
    ends, symbol, plain = n["stop"] + n["shout"], n["shout"] + n["symbol"], n["plain"] + n["stop"]
    around = np.stack([start, end], axis=1).ravel()  # words of the lines and of the breaks between them
    hashes, words = word_hashes(data[start[0] : end[-1]], around - start[0])
    place = np.concatenate([[0], np.cumsum(words)])
    place = np.stack([place[:-1:2], place[1::2]], axis=1)
    words = (place[:, 1] - place[:, 0]).astype(float)
    distinct = _distinct(hashes, place)
    letters = n["upper"] + n["lower"] + n["beyond"] / 2
    whole = np.maximum(size, 1)
    many = np.maximum(words, 1)
    last = _class[data[np.maximum(end - 1, 0)]] if len(data) else np.zeros(len(end), np.uint8)
    ended = (size > 0) & ((last == CLASSES.index("stop")) | (last == CLASSES.index("shout")))
    return np.stack(
        [
            np.log1p(size), np.log1p(words), letters / whole, n["upper"] / np.maximum(letters, 1), n["digit"] / whole, n["beyond"] / whole,
            plain / whole, np.sqrt(symbol / whole), np.sqrt(n["bar"] / whole), n["blank"] / whole, np.sqrt(ends / many), np.minimum(letters / many, 20),
            distinct / many, ended.astype(float), (size == 0).astype(float), np.sqrt(symbol / many),
        ],
        axis=1,
    )


def _beside(told: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Features: what a line tells beside what the lines around it tell; first and last lines of documents have none beyond."""
    out = np.zeros((len(told), 3 * TOLD + 2))
    out[:, :TOLD] = told
    out[1:, TOLD : 2 * TOLD] = told[:-1]
    out[:-1, 2 * TOLD : 3 * TOLD] = told[1:]
    out[first, TOLD : 2 * TOLD], out[last, 2 * TOLD : 3 * TOLD] = 0, 0
    out[first, -2], out[last, -1] = 1, 1
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of the texts data[offsets[i]:offsets[i+1]], each line's bytes, and each text's number of lines."""
    start, end, lines = _lines(data, offsets)
    last = np.cumsum(lines) - 1
    return _beside(told_of(data, start, end), last - lines + 1, last), end - start, lines


def _distinct(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many different hashes stand in each hashes[place[i, 0]:place[i, 1]]."""
    out = np.zeros(len(place))
    n = place[:, 1] - place[:, 0]
    long = n > WORDS_AT_ONCE
    for i in np.flatnonzero(long):
        own, parts = hashes[place[i, 0] : place[i, 1]], -(-int(n[i]) // WORDS_AT_ONCE)
        out[i] = sum(len(np.unique(own[own % np.uint64(parts) == np.uint64(k)] >> np.uint64(24))) for k in range(parts))
    n = np.where(long, 0, n)
    upto = np.cumsum(n)
    i = 0
    while i < len(place):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 2 * WORDS_AT_ONCE, side="right")))
        line, at = np.repeat(np.arange(j - i), n[i:j]), np.repeat(place[i:j, 0] - (upto[i:j] - n[i:j]), n[i:j]) + np.arange(upto[i] - n[i], upto[j - 1])
        if len(at):
            # a line's number above 40 bits of the hash: chance repeats don't matter to a feature
            key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (hashes[at] >> np.uint64(24)))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            out[i:j] += np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=j - i)
        i = j
    return out


# --- the field ---


def _products(steps: np.ndarray, longest: int) -> np.ndarray:
    """steps[start] @ ... @ steps[t] for each t, to a factor, by doubling; start is at least `longest` before t, where a chain is cut.

    steps has the four entries of the 2 x 2 matrices as rows, and so has what is returned.
    """
    a, b, c, d = _scaled(*steps)
    gap = 1
    while gap < min(longest, len(a)):
        e, f, g, h = a[gap:], b[gap:], c[gap:], d[gap:]
        p, q, r, s = a[:-gap], b[:-gap], c[:-gap], d[:-gap]
        new = _scaled(p * e + q * g, p * f + q * h, r * e + s * g, r * f + s * h)
        a, b, c, d = (np.concatenate([x[:gap], y]) for x, y in zip((a, b, c, d), new, strict=True))
        gap *= 2
    return np.stack([a, b, c, d])


def _scaled(a, b, c, d) -> tuple[np.ndarray, ...]:
    most = 1.0 / np.maximum(np.maximum(a, b), np.maximum(c, d))
    return a * most, b * most, c * most, d * most


def _steps(emit: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The steps' matrices (from, to), to a factor; a first line's has equal rows."""
    own = (np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30).T
    tie = np.exp(transition - transition.max())
    return np.stack([np.where(first, 1.0, tie[i, j]) * own[j] for i in (0, 1) for j in (0, 1)])


def _passed(message: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Messages (lines, 2) that a message becomes through each product of steps, each adding up to 1."""
    a, b, c, d = products
    out = np.stack([message[0] * a + message[1] * c, message[0] * b + message[1] * d], axis=1)
    return out / out.sum(axis=1, keepdims=True)


def forward_backward(emit: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each line's label, and of each pair of neighbours' labels (zero where a document starts).

    emit: log potentials of (bad, good); transition: log potentials of (from, to).
    """
    n = len(emit)
    first = np.zeros(n, bool)
    first[np.cumsum(lines) - lines] = True
    longest = int(lines.max(initial=1))
    steps = _steps(emit, transition, first)
    forward = _products(steps, longest)[:2].T
    forward /= forward.sum(axis=1, keepdims=True)
    # backward: the steps that follow, last to first, transposed
    following = np.ones((4, n))
    following[:, :-1] = steps[:, 1:]
    following[:, np.append(first[1:], True)] = 1.0
    backward = _products(following[[0, 2, 1, 3], ::-1], longest)[:2].T[::-1]
    marginal = forward * backward
    marginal /= marginal.sum(axis=1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    pair[1:] = forward[:-1, :, None] * steps.T.reshape(n, 2, 2)[1:] * backward[1:, None, :]
    pair[first] = 0
    total = pair.sum(axis=(1, 2), keepdims=True)
    return marginal, np.divide(pair, total, out=pair, where=total > 0)


@dataclass
class Model:
    """A few hundred numbers. prior is the score where nothing could be learned."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weight: np.ndarray | None = None  # (features + 1, 2)
    transition: np.ndarray | None = None

    def emit(self, told: np.ndarray) -> np.ndarray:
        return np.hstack([(told - self.mean) / self.scale, np.ones((len(told), 1))]) @ self.weight

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's score; texts are taken in groups of AT_ONCE, and longer ones by themselves."""
        texts = len(offsets) - 1
        if self.weight is None:
            return np.full(texts, self.prior)
        lines = np.ones(texts, np.int64)
        for a in range(0, len(data), SLICE):
            breaks = np.flatnonzero(data[a : a + SLICE] == 10) + a
            lines += np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=texts)
        upto = np.cumsum(np.diff(offsets) + LINE * lines)
        out, i = np.empty(texts), 0
        while i < texts:
            begun = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, begun + AT_ONCE, side="right")))
            some = data[offsets[i] : offsets[j]]
            out[i:j] = self.score_together(some, offsets[i : j + 1] - offsets[i]) if upto[j - 1] - begun <= AT_ONCE else self.score_long(some)
            i = j
        return out

    def score_together(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        told, size, lines = line_features(data, offsets)
        good = forward_backward(self.emit(told), self.transition, lines)[0][:, 1]
        weight = size + 1.0
        start = np.cumsum(lines) - lines
        return np.clip(np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start), 0.0, 1.0)

    def score_long(self, data: np.ndarray) -> float:
        """One text's score, in stretches of its lines: forward messages first, then marginals from the last stretch back."""
        cuts = [0]  # where stretches of lines begin
        lines = 0
        for a in range(0, len(data), SLICE):
            breaks = np.flatnonzero(data[a : a + SLICE] == 10) + a + 1
            cost = breaks - cuts[-1] + LINE * np.arange(lines + 1, lines + len(breaks) + 1)
            lines += len(breaks)
            while len(over := np.flatnonzero(cost > AT_ONCE)):
                k = int(over[0])
                cuts.append(int(breaks[k]))
                breaks, lines = breaks[k + 1 :], len(breaks) - k - 1
                cost = breaks - cuts[-1] + LINE * np.arange(1, lines + 1)
        cuts.append(len(data) + 1)

        def steps(k: int) -> tuple[np.ndarray, np.ndarray]:
            """A stretch's steps, and its lines' bytes; the lines beside it are read for their features."""
            a, b = cuts[k], min(cuts[k + 1], len(data) + 1) - 1
            start, end, _ = _lines(data[a:b], np.array([0, b - a]))
            start, end = start + a, end + a
            size, before, after = end - start, k > 0, k + 2 < len(cuts)
            if before:
                back = max(0, a - 1)
                start, end = np.insert(start, 0, _line_start(data, back)), np.insert(end, 0, back)
            if after:
                start, end = np.append(start, cuts[k + 1]), np.append(end, _line_end(data, cuts[k + 1]))
            none = np.zeros(0, np.int64)
            told = _beside(told_of(data, start, end), none if before else np.zeros(1, np.int64), none if after else np.array([len(start) - 1]))
            told = told[int(before) : len(told) - int(after)]
            first = np.zeros(len(told), bool)
            first[0] = not before
            return _steps(self.emit(told), self.transition, first), size

        messages = [np.array([0.5, 0.5])]
        for k in range(len(cuts) - 2):
            own = steps(k)[0]
            messages.append(_passed(messages[-1], _products(own, own.shape[1]))[-1])
        good = weight = 0.0
        back = np.array([1.0, 1.0])
        for k in range(len(cuts) - 2, -1, -1):
            own, size = steps(k)
            forward = _passed(messages[k], _products(own, own.shape[1]))
            turned = own[[0, 2, 1, 3], ::-1]
            passed = _passed(back, _products(turned, turned.shape[1]))[::-1]
            backward = np.vstack([passed[1:], back[None, :]])
            marginal = forward * backward
            good += float((marginal[:, 1] / marginal.sum(axis=1) * (size + 1.0)).sum())
            weight += float((size + 1.0).sum())
            back = passed[0]
        return min(1.0, max(0.0, good / weight))


def _line_start(data: np.ndarray, end: int) -> int:
    """Where the line that ends at `end` starts."""
    at = end
    while at > 0:
        a = max(0, at - SLICE)
        if len(breaks := np.flatnonzero(data[a:at] == 10)):
            return a + int(breaks[-1]) + 1
        at = a
    return 0


def _line_end(data: np.ndarray, start: int) -> int:
    for a in range(start, len(data), SLICE):
        if len(breaks := np.flatnonzero(data[a : a + SLICE] == 10)):
            return a + int(breaks[0])
    return len(data)


def learn(texts: list[tuple[str, int]], steps: int = STEPS) -> Model:
    """Maximum conditional likelihood with a ridge, by Adam on the whole sample."""
    if not texts:
        return Model(0.5)
    prior = sum(y for _, y in texts) / len(texts)
    if prior in (0, 1):
        return Model(prior)
    raw = [t.encode() for t, _ in texts]
    told, size, lines = line_features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    label = np.repeat(np.array([y for _, y in texts]), lines)
    model = Model(prior, told.mean(axis=0), np.maximum(told.std(axis=0), 1e-3), np.zeros((told.shape[1] + 1, 2)), np.zeros((2, 2)))
    x = np.hstack([(told - model.mean) / model.scale, np.ones((len(told), 1))])
    document = np.repeat(1.0 / lines, lines)[:, None]  # each document weighs the same, however many lines it has
    target = np.eye(2)[label]
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lines) - lines] = False
    paired = np.zeros((len(x), 2, 2))
    paired[inner, label[inner], label[inner]] = 1
    theta = [model.weight, model.transition]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for k in range(1, steps + 1):
        marginal, pair = forward_backward(x @ model.weight, model.transition, lines)
        slope = [x.T @ ((target - marginal) * document) / len(raw) - RIDGE * model.weight, ((paired - pair) * document[:, :, None]).sum(axis=0) / len(raw) - RIDGE * model.transition]
        for i, g in enumerate(slope):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            theta[i] += RATE * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(*flat_bytes(b.column("bytes"))))], names=["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes")).mapInArrow(run, f"doc_id {ids}, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold; a row is judged where it is, nothing is joined."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = b.column("text").fill_null("").cast(pa.binary())
                yield b.filter(pa.array(shared.value.score(*flat_bytes(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    found = score(docs, learn(sample(docs, labels, "quality", SAMPLE)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
