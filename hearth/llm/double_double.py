"""Double-double arithmetic on numpy arrays: a number is the unevaluated sum of a high and a low part, some 106 bits.

Error-free transformations after Dekker, Knuth and Moller.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """(a + b rounded, its exact error)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def settled(high, low) -> Pair:
    """The same number with parts that do not overlap, for a low part that is smaller."""
    s = high + low
    return s, low - (s - high)


def halves(a) -> Pair:
    """a as the sum of two numbers of 26 bits at most."""
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def two_prod(a, b, a_halves: Pair | None = None, b_halves: Pair | None = None) -> Pair:
    """(a * b rounded, its exact error)."""
    (ah, al), (bh, bl) = a_halves or halves(a), b_halves or halves(b)
    p = a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = settled(s, e + t)
    return settled(s, e + f)


def total(a: Pair) -> Pair:
    """The sum along the last axis, by halves."""
    high, low = a
    if not high.shape[-1]:
        return np.zeros(high.shape[:-1]), np.zeros(high.shape[:-1])
    while (n := high.shape[-1]) > 1:
        k = n // 2
        s = add((high[..., :k], low[..., :k]), (high[..., k : 2 * k], low[..., k : 2 * k]))
        if n % 2:
            s = tuple(np.concatenate([x, y[..., -1:]], -1) for x, y in zip(s, (high, low)))
        high, low = s
    return high[..., 0], low[..., 0]


def matmul(a: Pair, b: Pair) -> Pair:
    """The product of two matrices, one rank at a time."""
    out = np.zeros((a[0].shape[0], b[0].shape[1])), np.zeros((a[0].shape[0], b[0].shape[1]))
    for k in range(a[0].shape[1]):
        x, y = (a[0][:, k, None], a[1][:, k, None]), (b[0][None, k], b[1][None, k])
        p, e = two_prod(x[0], y[0])
        out = add(out, settled(p, e + (x[0] * y[1] + x[1] * y[0])))
    return out


def over(a: Pair, n: int) -> Pair:
    """a divided by a whole number below 2**53."""
    q = a[0] / n
    p, e = two_prod(q, float(n))
    return settled(q, ((a[0] - p) - e + a[1]) / n)


def fractions(a: Pair) -> list[Fraction]:
    return [Fraction(h) + Fraction(l) for h, l in zip(a[0].tolist(), a[1].tolist())]


def from_fractions(values: list[Fraction]) -> Pair:
    high = [float(v) for v in values]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(values, high)])
