"""Prefix hashes over the integers modulo 2^61 - 1, in numpy.

The hash of a sequence ``t_0 .. t_(n-1)`` is the pair of its length and ``sum t_i B^i``.  Pairs
form a monoid: ``(n, s) (m, r) = (n + m, s + B^n r)``.  Two bases make two independent sums.
"""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
#: Two bases below P; any two unrelated large numbers do.
BASES = (1_234_567_890_123_456_789, 2_001_002_003_004_005_007)
_LOW = np.uint64((1 << 31) - 1)
_MID = np.uint64((1 << 30) - 1)
_P = np.uint64(P)


def reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of numbers below P; partial products stay below 2^64."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    a1, a0 = a >> np.uint64(31), a & _LOW
    b1, b0 = b >> np.uint64(31), b & _LOW
    mid = a1 * b0 + a0 * b1
    upper = np.uint64(2) * (a1 * b1) + (mid >> np.uint64(30)) + ((mid & _MID) << np.uint64(31))
    return reduce(reduce(upper) + reduce(a0 * b0))


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(np.asarray(a, np.uint64) + np.asarray(b, np.uint64))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(np.asarray(a, np.uint64) + (_P - np.asarray(b, np.uint64)))


class Powers:
    """Powers of a base from 0 on, made as far as they are asked for."""

    def __init__(self, base: int):
        self.base = base
        self.table = np.array([1], dtype=np.uint64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        most = int(at.max(initial=0))
        while len(self.table) <= most:
            step = np.uint64(pow(self.base, len(self.table), P))
            self.table = np.concatenate([self.table, times(self.table, step)])
        return self.table[at]


def running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo P of ``values`` from index ``first[i]`` up to and with ``i``."""

    def sums(part: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        return total[1:] - total[first]

    upper, lower = sums(values >> np.uint64(31)), sums(values & _LOW)
    return plus(times(reduce(upper), np.uint64(1 << 31)), reduce(lower))
