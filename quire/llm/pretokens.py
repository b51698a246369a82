"""Splitting texts into the pre-tokens of a byte-level BPE, and remembering their ids.

The BPE of a text is the concatenation of the BPEs of its pre-tokens, so each worker encodes a distinct
pre-token once and looks it up from then on. The memory is bounded by two generations of MEMO pre-tokens: one that is
met moves to the young generation; when that is full it becomes the old one, and what was left in the old one is forgotten.
A long text is split stretch by stretch, cut before a blank that starts a pre-token whatever stands before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import regex

#: Unicode's White_Space, as the tokenizer's expression engine reads \s (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The published pattern of byte-level BPE with \s, \p{L} and \p{N} spelt out. Letters and numbers are tried first, as no
#: other alternative starts with one. ASCII and Latin-1 have versions for the faster engine.
SUFFIX = "'(?:[stmd]|re|ve|ll)"
WIDE = regex.compile(rf" ?\p{{L}}+| ?\p{{N}}+|{SUFFIX}| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ASCII = re.compile(rf" ?[A-Za-z]+| ?[0-9]+|{SUFFIX}| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
LATIN = re.compile(
    r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+|" + SUFFIX + "|"
    r" ?[^\t-\r \x85\xa0A-Za-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
BREAK = re.compile(rf" (?![{SPACE}])")
#: Distinct pre-tokens in a generation of a worker's memory.
MEMO = 200_000
#: Characters split at once.
STRETCH = 1 << 18


def split(text: str) -> list[str]:
    if text.isascii():
        return ASCII.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WIDE.findall(text)
    return LATIN.findall(text)


def stretches(text: str) -> Iterator[str]:
    """The text in parts whose pre-tokens are those of the text. A blank before anything but white space always begins one."""
    at = 0
    while len(text) - at > STRETCH and (cut := BREAK.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


#: Stands for the ids of a pre-token that must still be encoded; no pre-token has none.
HOLE = b""


class _Young(dict):
    """Pre-tokens to the bytes of their ids; one that is in the old generation moves here, any other is noted as missed."""

    def __init__(self, fixed: dict[str, bytes], old: dict[str, bytes]):
        super().__init__(fixed)
        self.old, self.missed = old, []

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            self.missed.append(word)
            return HOLE
        self[word] = ids
        return ids


class Memo:
    """Texts to ids, with new pre-tokens encoded in bulk.

    encode_new takes a list of pre-tokens and returns all their ids in one array, and the number of each one's ids.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int], most: int | None = None):
        self.encode_new, self.most = encode_new, most
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.young = _Young(self.special, {})

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, special tokens' strings kept whole."""
        if self.cut is None or not any(s in text for s in self.special):
            yield from map(split, stretches(text))
            return
        for k, part in enumerate(self.cut.split(text)):
            yield from [[part]] if k % 2 else map(split, stretches(part))

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and the number of each one's ids; end stands after each text."""
        if len(self.young) > (self.most or MEMO) + len(self.special):
            self.young = _Young(self.special, dict(self.young))
        young, place = self.young, self.young.__getitem__
        rows: list[list[bytes]] = []
        holes: list[tuple[list[bytes], int, str]] = []
        for text in texts:
            row: list[bytes] = []
            for words in self.pieces(text):
                at = len(row)
                row += map(place, words)
                for word in young.missed:  # in the order in which they stand
                    at = row.index(HOLE, at)
                    holes.append((row, at, word))
                    at += 1
                young.missed.clear()
            rows.append(row)
        if holes:
            new = list(dict.fromkeys(word for _, _, word in holes))
            ids, sizes = self.encode_new(new)
            raw, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(sizes)).tolist()
            young.update((word, raw[a:b]) for word, a, b in zip(new, [0, *ends], ends, strict=False))
            for row, at, word in holes:
                row[at] = young[word]
        if end is not None:
            last = np.array([end], "<u4").tobytes()
            for row in rows:
                row.append(last)
        parts = [b"".join(row) for row in rows]
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
