"""Hashing words and word shingles of many texts at once, with numpy, on their UTF-8 bytes.

A word's hash is the sum of its bytes, each times a multiplier of its place in the word, so a word may be hashed in
parts: bytes are taken SLICE at a time, whatever the texts' lengths, and only a slice's arrays are held besides the hashes.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
#: Bytes hashed at once.
SLICE = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of a shingle's words, by place.
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Of the second, independent family of hashes.
SECOND = 0x2545F4914F6CDD1D

_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_lowered = _lower.astype(np.uint64) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_multipliers: dict[int, np.ndarray] = {}


def multipliers(seed: int, start: int, n: int) -> np.ndarray:
    """Odd pseudo-random multipliers of the places start to start + n of a word."""
    held = _multipliers.get(seed)
    if held is None:
        held = _multipliers[seed] = mix(np.arange(1, 1025, dtype=np.uint64) * _R + np.uint64(seed)) | np.uint64(1)
    if start + n <= len(held):
        return held[start : start + n]
    return mix(np.arange(start + 1, start + n + 1, dtype=np.uint64) * _R + np.uint64(seed)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts data[offsets[i]:offsets[i+1]], A-Z lowered, and each text's number of words."""
    texts = len(offsets) - 1
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    values, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    open_ = 0  # bytes so far of a word that reaches the slice's end
    for a in range(0, len(data), SLICE):
        piece = data[a : a + SLICE]
        inside = ~_blank[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = begins[np.searchsorted(begins, a) : np.searchsorted(begins, a + len(piece))] - a
        first[own] = inside[own]
        goes_on = bool(open_ and inside[0] and not (len(own) and own[0] == 0))
        at = np.flatnonzero(inside)
        if not len(at):
            open_ = 0
            continue
        start = np.flatnonzero(first)
        place = np.searchsorted(at, start)  # where each word begins among the bytes of words
        size = np.diff(place, append=len(at))
        before = open_ if goes_on else 0
        within = np.arange(len(at))
        within -= np.repeat(place, size)
        times = multipliers(seed, 0, int(size.max()))[within]
        if before:
            times[: size[0]] = multipliers(seed, before, int(size[0]))
        value = np.add.reduceat(_lowered[piece[at]] * times, place)
        open_ = (before if len(size) == 1 else 0) + int(size[-1]) if inside[-1] else 0
        if goes_on:
            values[-1][-1:] += value[:1]
            value, start = value[1:], start[1:]
        if len(value):
            values.append(value)
            starts.append(start + a)
    return mix(np.concatenate(values)), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; fewer words than SIZE make one shingle, none an empty set."""
    words, counts = word_hashes(data, offsets, seed)
    place = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(words) - SIZE + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(SIZE):
        rolled += words[k : k + n] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for i, w in enumerate(counts.tolist()):
        at = int(place[i])
        if w >= SIZE:
            out.append(np.unique(rolled[at : at + w - SIZE + 1]))
        elif w:
            out.append(mix((words[at : at + w] * _PLACE[:w]).sum(keepdims=True, dtype=np.uint64) + np.uint64(w)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
