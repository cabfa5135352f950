"""Word shingles of texts as 64-bit hashes, computed on whole arrays."""

from __future__ import annotations

import numpy as np

_GEN = np.random.Generator(np.random.PCG64(9_176_204_411))
_BYTE = _GEN.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _GEN.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True  # fixed values: what parts words
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z lower-cased: polynomial sums over its bytes, mixed."""
    b = np.frombuffer(text.lower(), np.uint8)
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64)
    blank = _BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingles of `width` words; of fewer words the whole sequence; none without words."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    k = min(width, len(w))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out += w[j : len(w) - k + 1 + j] * _PLACE[j]
    return np.unique(mix(out))


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit signed hash of a set."""
    total = np.uint64(0)
    if len(shingles):
        total = np.add.reduce(mix(shingles ^ np.uint64(0xD1B54A32D192ED03)))
    return int(mix(np.array([total ^ np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])
