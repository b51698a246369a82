"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (for words seen in enough training documents) beside the last states of a
small bidirectional recurrent network over its characters. Windows of WINDOW words, every STRIDE words and
over the whole text, run through a second bidirectional network; attention pools a window's states and a
logistic unit scores it. A document's score is its highest window's.

Training has a bounded sample of labelled documents. Labels are for documents, so each document is
represented by the window that scores highest so far (at first, by the log-odds of its words and their
character fours; later, by the network), and rounds of choosing and learning alternate.

Scoring keeps each distinct word's projected input, so characters are read once per word and batch of memory.

Defined results
---------------
* A null text counts as empty; a text without words is one window without words and gets the output unit's bias.
* Words of more than LETTERS characters are read as several. Nothing is cut off.
* Without labelled documents of both kinds, every score is the share of label 1 among them, or 0.5 if there is none.
* Every row gives a row: repeated rows and null ids included. Only doc_id and text are read, and of the labels
  doc_id and the label.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, tune
from quire.llm.labelled import sample

#: Labelled documents that the network learns from, at most, and how many of them with label 1.
SAMPLE, POSITIVE = 2400, 800
THRESHOLD = 0.5
WINDOW, STRIDE = 64, 48
LETTERS = 24
CHARACTERS, CHAR_SIZE, CHAR_STATE = 512, 8, 6
WORD_SIZE, STATE = 8, 8
#: Training documents that a word must be in to have a vector of its own.
SEEN = 4
ROUNDS, EPOCHS, BATCH, RATE = 2, 5, 32, 0.01
#: Mean loss of an epoch at which a round ends early.
LEARNT = 0.01
#: Chance that a known word is taken for an unknown one in training, so that its characters count too.
FORGET = 0.5
#: Distinct words, as they stand in texts, that a worker knows from batch to batch; beyond that it begins anew.
MEMO = 200_000
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»¿¡…–—"


# --- a gated recurrent layer ---


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def two_ways(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Both ways of reading as one array (time, 2, ...), the second from the end on; both run in the same steps."""
    return np.stack([forward, backward[::-1]], axis=1)


def run_gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """States (time, ways, rows, size) for projected inputs x (time, ways, rows, 3 size) and weights u (ways, size, 3 size). Where mask is 0 the state stays."""
    steps, ways, rows, _ = x.shape
    size = u.shape[1]
    h = np.zeros((ways, rows, size), np.float32)
    out = np.empty((steps, ways, rows, size), np.float32)
    kept = [None] * steps
    for t in range(steps):
        hu = h @ u
        gate = _sigmoid(x[t, :, :, : 2 * size] + hu[:, :, : 2 * size])
        z, r = gate[:, :, :size], gate[:, :, size:]
        c = np.tanh(x[t, :, :, 2 * size :] + r * hu[:, :, 2 * size :])
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[t][:, :, None], new, h)
        if keep:
            kept[t] = (h, z, r, c, hu[:, :, 2 * size :])
        h = out[t] = new
    return out, kept


def back_gru(grad: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, from those of the states."""
    steps, ways, rows, size = grad.shape
    dx = np.zeros((steps, ways, rows, 3 * size), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros((ways, rows, size), np.float32)
    turned = u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, hc = kept[t]
        g = grad[t] + dh
        on = mask[t][:, :, None]
        stay = np.where(on, 0, g)
        g = np.where(on, g, 0)
        dc = g * (1 - z) * (1 - c * c)
        dz = g * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], axis=2)
        dhu = np.concatenate([dz, dr, dc * r], axis=2)
        du += h.transpose(0, 2, 1) @ dhu
        dh = stay + g * z + dhu @ turned
    return dx, du


# --- the network ---


def words_of(text: str) -> list[str]:
    return text.split()


def letters_of(word: str) -> str:
    return word.strip(STRIP).lower()


@dataclass
class Network:
    """Some hundred kB of parameters, and the list of known words. prior is the score where nothing could be learned."""

    prior: float
    known: dict[str, int] = field(default_factory=dict)
    theta: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, prior: float, known: dict[str, int], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        inputs = WORD_SIZE + 2 * CHAR_STATE
        shapes = {"chars": (CHARACTERS, CHAR_SIZE), "words": (len(known) + 1, WORD_SIZE), "attend": (2 * STATE, 1), "out": (2 * STATE, 1)}
        for way in "fb":
            shapes |= {f"cw{way}": (CHAR_SIZE, 3 * CHAR_STATE), f"cu{way}": (CHAR_STATE, 3 * CHAR_STATE), f"ww{way}": (inputs, 3 * STATE), f"wu{way}": (STATE, 3 * STATE)}
        theta = {k: (rng.normal(size=s) * (0.5 if k in ("chars", "words") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
        theta["words"][0] = 0
        theta |= {k: np.zeros(n, np.float32) for k, n in (("cbf", 3 * CHAR_STATE), ("cbb", 3 * CHAR_STATE), ("wbf", 3 * STATE), ("wbb", 3 * STATE), ("bias", 1))}
        return cls(prior, known, theta)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character numbers (letters, words) and their mask; a word of more than LETTERS characters must have been cut before."""
        size = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        flat = np.where(flat < 384, flat, 384 + flat % (CHARACTERS - 384))
        mask = np.arange(max(1, int(size.max(initial=0))))[:, None] < size[None, :]
        out = np.zeros(mask.T.shape, np.int64)
        out[mask.T] = flat
        return out.T, mask

    def read_words(self, words: list[str], forget: np.random.Generator | None = None, keep: bool = False):
        """Inputs (words, size) of distinct words."""
        t = self.theta
        spelt, mask = self.spell(words)
        x = t["chars"][spelt]
        states, kept = run_gru(two_ways(x @ t["cwf"] + t["cbf"], x @ t["cwb"] + t["cbb"]), np.stack([t["cuf"], t["cub"]]), two_ways(mask, mask), keep)
        number = np.array([self.known.get(w, 0) for w in words])
        if forget is not None:
            number = np.where(forget.random(len(number)) < FORGET, 0, number)
        inputs = np.hstack([t["words"][number], states[-1, 0], states[-1, 1]])
        return (inputs, (spelt, mask, x, kept, number)) if keep else inputs

    def project(self, inputs: np.ndarray) -> np.ndarray:
        t = self.theta
        return np.hstack([inputs @ t["wwf"] + t["wbf"], inputs @ t["wwb"] + t["wbb"]]).astype(np.float32)

    def score_windows(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Log-odds of windows (n, WINDOW) of rows of table; -1 where a window has no word."""
        t, out = self.theta, np.empty(len(windows), np.float32)
        whole = (windows >= 0).all(axis=1)
        for some, full in ((np.flatnonzero(whole), True), (np.flatnonzero(~whole), False)):
            for i in range(0, len(some), 1024):
                at = some[i : i + 1024]
                w = windows[at].T
                if not full:  # the words of a short window stand first
                    w = w[: max(1, int((w >= 0).sum(axis=0).max()))]
                mask = None if full else w >= 0
                x = table[np.maximum(w, 0)]
                h, _ = run_gru(two_ways(x[:, :, : 3 * STATE], x[:, :, 3 * STATE :]), np.stack([t["wuf"], t["wub"]]), None if full else two_ways(mask, mask))
                f, b = h[:, 0], h[::-1, 1]
                note = (f @ t["attend"][:STATE] + b @ t["attend"][STATE:])[:, :, 0]
                said = (f @ t["out"][:STATE] + b @ t["out"][STATE:])[:, :, 0]
                if mask is not None:
                    note = np.where(mask, note, -1e9)
                weight = np.exp(note - note.max(axis=0))
                if mask is not None:
                    weight *= mask
                total = weight.sum(axis=0)
                out[at] = np.divide((weight * said).sum(axis=0), total, out=np.zeros_like(total), where=total > 0) + t["bias"][0]
        return out

    def slopes(self, windows: list[list[str]], label: np.ndarray, rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows of words."""
        t = self.theta
        distinct = sorted(set().union(*windows)) or [""]
        place = {w: i for i, w in enumerate(distinct)}
        inputs, (spelt, cmask, cx, ckept, number) = self.read_words(distinct, rng, True)
        steps = max(1, max(map(len, windows)))
        at = np.zeros((steps, len(windows)), np.int64)
        mask = np.zeros((steps, len(windows)), bool)
        for k, w in enumerate(windows):
            at[: len(w), k] = [place[x] for x in w]
            mask[: len(w), k] = True
        v = inputs[at]
        states, kept = run_gru(two_ways(v @ t["wwf"] + t["wbf"], v @ t["wwb"] + t["wbb"]), np.stack([t["wuf"], t["wub"]]), two_ways(mask, mask), True)
        h = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        note = np.where(mask, (h @ t["attend"])[:, :, 0], -1e9)
        weight = np.exp(note - note.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        said = (h @ t["out"])[:, :, 0]
        logit = (weight * said).sum(axis=0) + t["bias"][0]
        p = _sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(label == 1, p, 1 - p) + 1e-9)))
        d = ((p - label) / len(label)).astype(np.float32)
        dsaid = weight * d
        dnote = weight * (said - (weight * said).sum(axis=0)) * d
        g = {"bias": np.array([d.sum()], np.float32), "out": np.einsum("twh,tw->h", h, dsaid)[:, None], "attend": np.einsum("twh,tw->h", h, dnote)[:, None]}
        dh = dsaid[:, :, None] * t["out"][:, 0] + dnote[:, :, None] * t["attend"][:, 0]
        dv = np.zeros_like(v)
        both, du = back_gru(two_ways(dh[:, :, :STATE], dh[:, :, STATE:]), kept, np.stack([t["wuf"], t["wub"]]), two_ways(mask, mask))
        for k, (way, dx) in enumerate((("f", both[:, 0]), ("b", both[::-1, 1]))):
            g[f"wu{way}"] = du[k]
            g[f"ww{way}"] = v.reshape(-1, v.shape[2]).T @ dx.reshape(-1, dx.shape[2])
            g[f"wb{way}"] = dx.sum(axis=(0, 1))
            dv += dx @ t[f"ww{way}"].T
        dinputs = np.zeros_like(inputs)
        np.add.at(dinputs, at[mask], dv[mask])
        g["words"] = np.zeros_like(t["words"])
        np.add.at(g["words"], number, dinputs[:, :WORD_SIZE])
        g["words"][0] = 0
        dcx = np.zeros_like(cx)
        grad = np.zeros((len(spelt), 2, spelt.shape[1], CHAR_STATE), np.float32)
        grad[-1, 0], grad[-1, 1] = dinputs[:, WORD_SIZE : WORD_SIZE + CHAR_STATE], dinputs[:, WORD_SIZE + CHAR_STATE :]
        both, du = back_gru(grad, ckept, np.stack([t["cuf"], t["cub"]]), two_ways(cmask, cmask))
        for k, (way, dx) in enumerate((("f", both[:, 0]), ("b", both[::-1, 1]))):
            g[f"cu{way}"] = du[k]
            g[f"cw{way}"] = cx.reshape(-1, cx.shape[2]).T @ dx.reshape(-1, dx.shape[2])
            g[f"cb{way}"] = dx.sum(axis=(0, 1))
            dcx += dx @ t[f"cw{way}"].T
        g["chars"] = np.zeros_like(t["chars"])
        np.add.at(g["chars"], spelt[cmask], dcx[cmask])
        return loss, g


def cut_words(text: str) -> list[str]:
    """A text's words, stripped and lower-cased, long ones in pieces."""
    out = []
    for raw in words_of(text):
        w = letters_of(raw)
        if w:
            out += [w] if len(w) <= LETTERS else [w[i : i + LETTERS] for i in range(0, len(w), LETTERS)]
    return out


def window_starts(n: int) -> range | list[int]:
    """Where windows of a text of n words start: every STRIDE words, the last one moved back to be whole."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


# --- training ---


def fours(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 4] for i in range(max(1, len(w) - 3))]


def first_choice(texts: list[list[str]], label: np.ndarray) -> tuple[list[np.ndarray], dict[str, float]]:
    """For each text its words' suspicion: log-odds of the word and of its most telling character four, by documents; and all log-odds."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    shapes = {w: fours(w) for t in texts for w in t}
    for words, y in zip(texts, label, strict=True):
        counts[y].update({f for w in set(words) for f in (w, *shapes[w])})
    n = [max(1, int((label == y).sum())) for y in (0, 1)]
    odds = {f: np.log((counts[1][f] + 0.5) / (n[1] + 1)) - np.log((counts[0][f] + 0.5) / (n[0] + 1)) for f in counts[0].keys() | counts[1].keys()}
    suspicion = {w: odds.get(w, 0.0) + max(odds[f] for f in s) for w, s in shapes.items()}
    return [np.array([suspicion[w] for w in t]) for t in texts], odds


def learn(sampled: list[tuple[str, int]], rounds: int = ROUNDS, epochs: int = EPOCHS) -> Network:
    if not sampled:
        return Network(0.5)
    label = np.array([y for _, y in sampled])
    prior = float(label.mean())
    if prior in (0, 1):
        return Network(prior)
    texts = [cut_words(t) for t, _ in sampled]
    seen = Counter(w for t in texts for w in set(t))
    known = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= SEEN))}
    net, rng = Network.new(prior, known), np.random.default_rng(11)
    suspicion, odds = first_choice(texts, label)
    for w, i in known.items():  # the first component starts as what single words tell
        net.theta["words"][i, 0] = np.clip(odds[w], -2, 6) / 2
    owner = np.repeat(np.arange(len(texts)), [len(window_starts(len(t))) for t in texts])
    starts = np.concatenate([window_starts(len(t)) for t in texts]).astype(int)
    merit = np.array([np.sort(suspicion[o][s : s + WINDOW])[-3:].sum() if len(texts[o]) else 0.0 for o, s in zip(owner, starts, strict=True)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.theta.items()}
    step, per_epoch = 0, max(1, -(-2 * len(texts) // BATCH))
    epochs = max(epochs, -(-300 // per_epoch))
    for r in range(rounds):
        order = np.lexsort((-merit, owner))
        best = order[np.searchsorted(owner[order], np.arange(len(texts)))]
        for _ in range(epochs):
            losses = []
            other = rng.permutation(np.flatnonzero(label[owner] == 0))[: len(texts)]  # any window of a clean text is clean
            batchwise = rng.permutation(np.concatenate([best, other]))
            for i in range(0, len(batchwise), BATCH):
                some = batchwise[i : i + BATCH]
                loss, g = net.slopes([texts[owner[k]][starts[k] : starts[k] + WINDOW] for k in some], label[owner[some]], rng)
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    m, s = moments[k]
                    x = x.astype(np.float32) * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                    m += 0.1 * (x - m)
                    s += 0.01 * (x * x - s)
                    net.theta[k] -= (RATE * (0.5**r) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if np.mean(losses) < LEARNT:
                break
        if r + 1 < rounds:
            merit = Scorer(net).window_scores(texts)
    return net


# --- scoring ---


class Scorer:
    """A network with the projected inputs of words it has met: at most MEMO forms and one batch's."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # of words as the network reads them
        self.raw: dict[str, int] = {}  # of words as they stand in texts; below 0: -1 minus the place in long
        self.long: list[np.ndarray] = []
        self.pieces = 0  # in long, and its entries
        self.table = np.zeros((1, 6 * STATE), np.float32)
        self.used = 0

    def learn_words(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.place]
        new.sort(key=len)  # words of like length together, so that little is padded
        if self.used + len(new) > len(self.table):
            more = np.zeros((max(2 * len(self.table), self.used + len(new), 4096), 6 * STATE), np.float32)
            more[: self.used] = self.table[: self.used]
            self.table = more
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            self.table[self.used : self.used + len(some)] = self.net.project(self.net.read_words(some))
            self.place.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)

    def full(self) -> bool:
        """Whether any part of the memory is: words read, forms seen, or pieces of the forms that are several words."""
        return max(self.used, len(self.raw), self.pieces) > MEMO

    def window_scores(self, texts: list[list[str]]) -> np.ndarray:
        """Log-odds of all windows of texts given as words, text by text."""
        if self.full():
            self.clear()
        self.learn_words(list(set().union(*texts)))
        rows = [np.fromiter(map(self.place.__getitem__, t), np.int64, len(t)) for t in texts]
        return self._windows(rows)[0]

    def _windows(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([*rows, np.full(WINDOW, -1)])
        base = np.cumsum([0, *map(len, rows)])
        begins = [window_starts(len(r)) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(b) for b in begins])
        start = np.concatenate([np.asarray(b) for b in begins]) if rows else np.zeros(0, np.int64)
        at = (base[owner] + start)[:, None] + np.arange(WINDOW)
        windows = np.where(at < base[owner + 1][:, None], flat[np.minimum(at, len(flat) - 1)], -1)
        return self.net.score_windows(self.table, windows), owner

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability for each text."""
        if not self.net.theta:
            return np.full(len(texts), self.net.prior)
        if self.full():
            self.clear()
        raw = [words_of(t) for t in texts]
        place = self.raw
        new = set().union(*raw).difference(place)
        simple, pieces = {}, {}
        for w in new:
            cut = cut_words(w)
            if len(cut) == 1:
                simple[w] = cut[0]
            else:
                pieces[w] = cut
        self.learn_words(list({*simple.values(), *(x for c in pieces.values() for x in c)}))
        place.update((w, self.place[c]) for w, c in simple.items())
        for w, c in pieces.items():  # nothing but marks, or a long word
            place[w] = -1 - len(self.long)
            self.long.append(np.array([self.place[x] for x in c], np.int64))
            self.pieces += 1 + len(c)
        rows = [self._unfold(np.fromiter(map(place.__getitem__, t), np.int64, len(t))) for t in raw]
        scores, owner = self._windows(rows)
        highest = np.full(len(rows), -np.inf)
        np.maximum.at(highest, owner, scores)
        return 1 / (1 + np.exp(-highest))

    def _unfold(self, row: np.ndarray) -> np.ndarray:
        odd = np.flatnonzero(row < 0)
        if not len(odd):
            return row
        parts, at = [], 0
        for i in odd:
            parts += [row[at:i], self.long[-1 - row[i]]]
            at = i + 1
        return np.concatenate([*parts, row[at:]])


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score: every whole text's score."""
    tune(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(net), hashlib.sha256(pickle.dumps(net)).hexdigest()
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scorers[key].score([t or "" for t in b.column("text").to_pylist()]).astype(float))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    found = score(docs, learn(sample(docs, labels, "toxic", SAMPLE, POSITIVE)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
