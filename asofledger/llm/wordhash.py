"""Words of many texts at once, as positions and 64-bit hashes over one byte buffer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose prefix sums are held at a time.
BLOCK = 1 << 18


@lru_cache(maxsize=4)
def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0..n-1 modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(factor, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs where inside holds; a run ends with its text."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    begin[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes and length; equal spans have equal hashes wherever they stand. Starts and ends rise. Prefix sums are held for BLOCK bytes at a time, so a long buffer needs no more than its spans."""
    first, after, shift = (np.zeros(len(starts), dtype=np.uint64) for _ in range(3))
    carry = np.uint64(0)
    for at in range(0, len(data) + 1, BLOCK):
        part = data[at : at + BLOCK]
        total = np.full(len(part) + 1, carry)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)) * np.uint64(pow(BASE, at, 1 << 64)), out=total[1:])
        total[1:] += carry
        carry = total[-1]
        own = slice(*np.searchsorted(starts, (at, at + BLOCK)))
        first[own] = total[starts[own] - at]
        shift[own] = powers(_INVERSE, BLOCK)[starts[own] - at] * np.uint64(pow(_INVERSE, at, 1 << 64))
        own = slice(*np.searchsorted(ends, (at, at + BLOCK)))
        after[own] = total[ends[own] - at]
    return mix((after - first) * shift + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
