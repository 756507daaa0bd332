"""Hashed word shingles of many texts at once.

Words are the runs of bytes other than space and \\t-\\r, with A-Z in lower case.  The
shingles of a text are its runs of ``k`` words, or all its words where it has fewer;
a text without words has none.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output looks random (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, hash, size in bytes) of every word of every text, in order."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    if not len(data):
        return none
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return none
    sizes = np.flatnonzero(edge == -1) - starts  # the last byte is a line feed
    inside = np.flatnonzero(word)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(inside)) - np.repeat(at, sizes)
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(terms, at) + sizes.astype(np.uint64) * _GOLD)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(bounds, starts, "right"), hashes, sizes


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of every shingle of every text, in order; repeats are kept."""
    owner, hashes, _ = word_hashes(texts)
    if not len(owner):
        return owner, hashes
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    of = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(counts, k)[of]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = length.astype(np.uint64)
    for t in range(k):
        out = mix(out * _GOLD + np.where(t < length, padded[begin + t], np.uint64(0)))
    return of, out


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, each distinct hash of a text once, by text and hash."""
    of, hashes = shingles(texts, k)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]
