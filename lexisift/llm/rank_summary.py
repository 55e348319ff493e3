"""Deterministic rank-interval summaries of numbers.

A summary is a sorted list of tuples (v, g, d): the smallest possible rank of v is the sum
of g up to it, its largest possible rank is d more. `uncertainty` is the largest g + d of
any tuple; a rank is answered with an error of at most half of it.

Compressing joins neighbours into a tuple whose g + d, the g that comes from outside included,
stays within a permitted width. Level l may use the share 1 - 1 / 2 ** (l + 1) of 2 * eps * n,
so that each level has room of its own and any number of them stays within 2 * eps * n. Merging
adds uncertainties as it adds counts, which keeps the relative error; the uncertainty really
reached is measured and kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Summary:
    v: np.ndarray
    g: np.ndarray
    d: np.ndarray
    n: int
    level: int = 0

    @property
    def uncertainty(self) -> int:
        return int((self.g + self.d).max()) if len(self.g) else 0

    @property
    def exact(self) -> bool:
        return self.n == len(self.v)


def exact(values: np.ndarray) -> Summary:
    """The summary of all `values` as they are; NaN is no value."""
    v = np.asarray(values, dtype=np.float64)
    v = np.sort(v[~np.isnan(v)])
    return Summary(v, np.ones(len(v), np.int64), np.zeros(len(v), np.int64), len(v))


def width(n: int, level: int, eps: float) -> int:
    """The largest g + d that compressing at `level` may make."""
    return int(2 * eps * n * (1 - 0.5 ** (level + 1)))


def compress(s: Summary, eps: float) -> Summary:
    """`s` with fewer tuples, none of them wider than its level allows unless it was so before.

    A kept tuple takes over all g since the kept one before it, and its largest rank stays.
    So from the smallest rank of the kept one, the next may be any whose largest rank is at
    most `width` above; the furthest is taken. The minimum stays, and the maximum.
    """
    most = width(s.n, s.level, eps)
    if most < 2 or len(s.v) <= 2:
        return s
    low = np.cumsum(s.g)
    high = low + s.d
    following = np.maximum(np.searchsorted(high, low + most, "right") - 1, np.arange(1, len(low) + 1)).tolist()
    at, last = [0], len(low) - 1
    while at[-1] < last:
        at.append(min(following[at[-1]], last))
    kept = np.array(at)
    return Summary(s.v[kept], np.diff(low[kept], prepend=0), s.d[kept], s.n, s.level)


def _pair(a: Summary, b: Summary) -> Summary:
    def wider(own: Summary, other: Summary, side: str) -> np.ndarray:
        following = np.append(other.g + other.d - 1, 0)
        return own.d + following[np.searchsorted(other.v, own.v, side)]

    v = np.concatenate([a.v, b.v])
    order = np.argsort(v, kind="stable")
    g, d = np.concatenate([a.g, b.g]), np.concatenate([wider(a, b, "left"), wider(b, a, "right")])
    return Summary(v[order], g[order], d[order], a.n + b.n, max(a.level, b.level))


def merge(parts: list[Summary], eps: float) -> Summary:
    """One summary of all values of `parts`, one level above the highest of them."""
    whole = [p for p in parts if p.exact]
    parts = [p for p in parts if not p.exact]
    if whole:
        parts.append(exact(np.concatenate([p.v for p in whole])))
    if not parts:
        return exact(np.empty(0))
    while len(parts) > 1:
        parts = [_pair(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    s = parts[0]
    return compress(Summary(s.v, s.g, s.d, s.n, s.level + 1), eps)


def quantile(s: Summary, p: float) -> float | None:
    """The value whose rank is ceil(p * n), within half the summary's uncertainty."""
    if not s.n:
        return None
    rank = max(1, int(np.ceil(p * s.n - 1e-9)))
    low = np.cumsum(s.g)
    return float(s.v[np.argmin(np.maximum(np.abs(rank - low), np.abs(low + s.d - rank)))])
