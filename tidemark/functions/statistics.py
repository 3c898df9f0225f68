"""Distributions and tests in plain Python, from sufficient statistics that Spark aggregates."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            value *= change
        if abs(change - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else math.nan
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def welch(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> tuple[float, float]:
    """Statistic and two-sided p of Welch's test; equal constants give 0 and 1, unequal ones infinity and 0."""
    if n1 < 2 or n2 < 2:
        return math.nan, math.nan
    a, b = v1 / n1, v2 / n2
    if a + b == 0:
        return (0.0, 1.0) if m1 == m2 else (math.copysign(math.inf, m1 - m2), 0.0)
    t = (m1 - m2) / math.sqrt(a + b)
    return t, t_two_sided(t, (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)))


@lru_cache(maxsize=256)
def _rank_sum_ways(n1: int, n2: int) -> tuple[int, ...]:
    """Orders of two samples by their Mann-Whitney statistic."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1), object)
    ways[0, 0] = 1
    for rank in range(1, n1 + n2 + 1):
        for k in range(min(rank, n1), 0, -1):
            step = rank - k
            if step <= n1 * n2:
                ways[k, step:] += ways[k - 1, : n1 * n2 + 1 - step]
    return tuple(ways[n1])


def mann_whitney(n1: int, n2: int, rank_sum: float, ties: float) -> tuple[float, float]:
    """U of the first sample and its two-sided p: exact if a sample has 8 or fewer and there are no ties, else normal.

    ``ties`` is the sum of t ** 3 - t over groups of equal values.
    """
    if not n1 or not n2:
        return math.nan, math.nan
    u = rank_sum - n1 * (n1 + 1) / 2
    low = min(u, n1 * n2 - u)
    if min(n1, n2) <= 8 and not ties:
        ways = _rank_sum_ways(n1, n2)
        return u, min(1.0, 2 * float(sum(ways[: math.floor(low) + 1]) / sum(ways)))
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    if spread == 0:
        return u, 1.0
    return u, min(1.0, 2 * normal_tail(max(0.0, (n1 * n2 / 2 - low - 0.5) / spread)))


def two_proportions(k1: int, n1: int, k2: int, n2: int) -> tuple[float, float]:
    if not n1 or not n2:
        return math.nan, math.nan
    p = (k1 + k2) / (n1 + n2)
    spread = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    if spread == 0:
        return 0.0, 1.0
    z = (k1 / n1 - k2 / n2) / spread
    return z, 2 * normal_tail(abs(z))


def benjamini_yekutieli(p: list[float | None]) -> list[float | None]:
    """Adjusted p-values of a whole family; a missing one counts as 1 and stays missing."""
    n = len(p)
    filled = [1.0 if x is None or math.isnan(x) else x for x in p]
    factor = sum(1 / k for k in range(1, n + 1))
    out: list[float | None] = [None] * n
    low = 1.0
    for rank, k in reversed(list(enumerate(sorted(range(n), key=lambda k: filled[k]), 1))):
        low = min(low, filled[k] * n * factor / rank)
        out[k] = low
    return [None if x is None or math.isnan(x) else a for x, a in zip(p, out, strict=True)]


def kappa(counts: list[tuple[str, str, int]]) -> float:
    """Cohen's kappa of a contingency table of two labels."""
    n = sum(c for *_, c in counts)
    agree = sum(c for a, b, c in counts if a == b) / n
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    for a, b, c in counts:
        left[a], right[b] = left.get(a, 0) + c, right.get(b, 0) + c
    chance = sum(v * right.get(k, 0) for k, v in left.items()) / n**2
    return 1.0 if chance == 1 else (agree - chance) / (1 - chance)


def seed_of(*key: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big")


def block_bootstrap(target: np.ndarray, own: np.ndarray, segment: np.ndarray, block: int, rounds: int, seed: int) -> dict[str, float | None]:
    """A moving-block interval and p-value of the difference of means between rows that have a label and the rest.

    Blocks lie within segments; a segment shorter than a block, or too few rows, gives nothing.
    """
    n = len(target)
    nothing = {"estimate": None, "low": None, "high": None, "p": None, "valid": 0}
    starts: list[int] = []
    cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if n else np.zeros(0, int)
    for a, b in zip(cut, np.r_[cut[1:], n], strict=True):
        if b - a < block:
            return nothing
        starts += range(int(a), int(b) - block + 1)
    if n < 4 * block or min(own.sum(), n - own.sum()) < 2:
        return nothing
    effect = lambda t, o: t[o].mean() - t[~o].mean() if o.any() and not o.all() else math.nan
    rng = np.random.default_rng(seed)
    estimate = effect(target, own)
    need = -(-n // block)
    drawn = []
    for _ in range(rounds):
        rows = (rng.choice(starts, need)[:, None] + np.arange(block)).ravel()[:n]
        drawn.append(effect(target[rows], own[rows]))
    got = np.array(drawn)
    got = got[~np.isnan(got)]
    if len(got) < 0.9 * rounds:
        return nothing | {"valid": len(got)}
    lo, hi = np.quantile(got, [0.025, 0.975])
    p = (1 + int((np.abs(got - estimate) >= abs(estimate)).sum())) / (len(got) + 1)
    return {"estimate": float(estimate), "low": float(2 * estimate - hi), "high": float(2 * estimate - lo), "p": p, "valid": len(got)}
