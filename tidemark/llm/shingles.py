"""Hashes of words and of runs of words, for whole texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, n.bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits so that any of them can serve as a bucket."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased; words are split by space and the characters 9 to 13)."""
    if not text:
        return np.zeros(0, np.uint64)
    data = text.encode().translate(_LOWER)
    if len(data) <= _BLOCK:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def _word_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), dtype=np.uint64)])
    return mix((total[end] - total[start]) * _power(_BACK, len(b))[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if there are fewer; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    out = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
    return np.unique(mix(out + np.uint64(k)))
