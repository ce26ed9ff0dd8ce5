"""64-bit hashes of all words of a byte array at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2^64; a worker keeps those of usual size."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        made = []
        for base in (_BASE, _BACK):
            p = np.full(size + 1, base)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 1 << 21:
            return made[0], made[1]
        _powers[size] = made[0], made[1]
    return _powers[size]


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each run of bytes that is inside; the last byte must not be.

    A word's hash is its polynomial in the base: the difference of running sums at its ends, shifted
    back to place 0, then mixed."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    up, down = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start])
