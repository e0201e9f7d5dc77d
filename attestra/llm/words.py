"""Words and shingles of whole columns of texts, by numpy over their UTF-8 bytes.

A word is a run of ASCII digits, ASCII letters (upper case counts as lower case) and characters outside ASCII.
"""

from __future__ import annotations

import numpy as np

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, the same wherever the span stands."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, then start, end and text number of each word."""
    folded = _FOLD[data]
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[1:] > offsets[:-1])]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    inner = edges[edges > 0] - 1
    stops[inner] = inside[inner]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return folded, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and the number of words of each text."""
    folded, starts, ends, owner = word_spans(data, offsets)
    return span_hashes(folded, starts, ends), np.bincount(owner, minlength=len(offsets) - 1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every k consecutive words, and how many each text has; a text of fewer words, but not none, has one shingle of all."""
    many = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    owner = np.repeat(np.arange(len(counts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, left = first[owner] + place, counts[owner] - place
    out = np.zeros(len(at), np.uint64)
    short = counts.size and bool((counts[counts > 0] < k).any())
    for j in range(k):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        if short:
            ok = left > j
            out[ok] += hashes[at[ok] + j] * factor
        else:
            out += hashes[at + j] * factor
    return mix(out), many
