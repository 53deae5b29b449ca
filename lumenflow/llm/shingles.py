"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd base of the polynomial over bytes (mod 2 ** 64) and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, by in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, by, _U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (the finisher of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``."""
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_bounds(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, joined by one space, and where each starts and ends."""
    data = b" ".join(text.encode().translate(_LOWER).split())
    if not data:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words the whole sequence is one; without words none."""
    data, starts, ends = word_bounds(text or "")
    if not len(starts):
        return np.zeros(0, _U)
    if len(starts) < words:
        return spans(data, starts[:1], ends[-1:])
    return np.unique(spans(data, starts[: len(starts) - words + 1], ends[words - 1 :]))
