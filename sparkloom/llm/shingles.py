"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .blocks import U64, mix

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WIDTH = U64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], width: int, words: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text, and where each text's begin; fewer words are one shingle, none are none."""
    words = _Words() if words is None else words
    sets, bounds = [], [0]
    for text in texts:
        w = text.translate(_LOWER).split()
        n = len(w)
        if not n:
            bounds.append(bounds[-1])
            continue
        a = np.fromiter(map(words.__getitem__, w), U64, n)
        k = min(width, n)
        h = np.full(n - k + 1, k, U64)
        for j in range(k):
            h = (h + a[j : n - k + 1 + j]) * _WIDTH
            h ^= h >> U64(31)
        h = np.unique(mix(h))
        sets.append(h)
        bounds.append(bounds[-1] + len(h))
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.array(bounds)


def new_words() -> _Words:
    return _Words()


def seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=U64) + U64(salt << 32)
    return mix(k), mix(k * U64(0xD6E8FEB86659FD93)) | U64(1)


def signatures(sets: np.ndarray, begin: np.ndarray, n: int, salt: int) -> np.ndarray:
    """MinHash of each set (``begin``: where each, none of them empty, begins) in 64-bit values."""
    out = np.empty((len(begin), n), U64)
    xor, factor = seeds(n, salt)
    step = 1 << 15  # stays in cache
    if not len(begin):
        return out
    ends = np.append(begin[1:], len(sets))
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(ends, begin[at] + step, side="right")))
        piece, cuts = sets[begin[at] : ends[stop - 1]], begin[at:stop] - begin[at]
        for k in range(n):
            out[at:stop, k] = np.minimum.reduceat((piece ^ xor[k]) * factor[k], cuts)
        at = stop
    return out
