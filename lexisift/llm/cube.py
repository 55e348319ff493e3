"""The cube method for two balancing variables: the number of units and their sizes.

Flight: while three units have fractional probabilities, these move along the null space of
the two balancing equations, in a random direction that keeps each unit's expectation, until
one of them is 0 or 1. Both totals stay as they are. At most two units stay fractional.
The largest units are settled first, each against all others at once, so that what stays
is small. Landing: those are rounded so that the totals move least.
"""

from __future__ import annotations

from itertools import product

import numpy as np

#: Probabilities this near to 0 or 1 are settled.
NEAR = 1e-9
#: So many of the largest units are settled before the flight over the others.
LARGEST = 200


def _settle(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """`p` with the largest units at 0 or 1; the others, by their room to move, keep both totals."""
    p = p.copy()
    for i in np.argsort(-x, kind="stable")[:LARGEST]:
        while NEAR < p[i] < 1 - NEAR:
            others = np.flatnonzero((p > NEAR) & (p < 1 - NEAR) & (np.arange(len(p)) != i))
            w, y = np.minimum(p[others], 1 - p[others]), x[others]
            a, b, c = w.sum(), (w * y).sum(), (w * y * y).sum()
            if len(others) < 3 or a * c - b * b <= 1e-12 * a * c:
                break
            level, slope = (b * x[i] - c) / (a * c - b * b), (b - a * x[i]) / (a * c - b * b)
            at, u = np.append(others, i), np.append(w * (level + slope * y), 1.0)
            with np.errstate(divide="ignore"):
                up = np.where(u > 0, (1 - p[at]) / u, np.where(u < 0, -p[at] / u, np.inf)).min()
                down = np.where(u > 0, p[at] / u, np.where(u < 0, (p[at] - 1) / u, np.inf)).min()
            p[at] += (up if rng.random() * (up + down) < down else -down) * u
            near = np.abs(p - np.round(p)) <= NEAR
            p[near] = np.round(p[near])
    return p


def flight(sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """The probabilities after the flight phase: all but two at most are 0 or 1."""
    rng, p, x = np.random.default_rng(seed), np.clip(np.asarray(p, np.float64), 0, 1), np.asarray(sizes, np.float64)
    out, draws, x = _settle(x, p, rng).tolist(), rng.random(len(p)).tolist(), x.tolist()
    active: list[int] = []
    for at in range(len(out)):
        if not NEAR < out[at] < 1 - NEAR:
            out[at] = round(out[at])
            continue
        active.append(at)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, step in zip(active, u):
            if step > 0:
                up, down = min(up, (1 - out[i]) / step), min(down, out[i] / step)
            elif step < 0:
                up, down = min(up, -out[i] / step), min(down, (out[i] - 1) / step)
        move = up if draws[at] * (up + down) < down else -down
        for i, step in zip(active, u):
            out[i] += move * step
        for i in active:
            if not NEAR < out[i] < 1 - NEAR:
                out[i] = float(round(out[i]))
        active = [i for i in active if 0 < out[i] < 1]
    return np.array(out)


def landing(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """`p` with the last fractional units, two at most, at 0 or 1: total size first, then number."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at) > 2:
        raise ValueError("landing needs a flight before it")
    choices = [np.array(c, np.float64) for c in product((0, 1), repeat=len(at))]
    best = min(choices, key=lambda c: (abs(((c - p[at]) * sizes[at]).sum()), abs((c - p[at]).sum())))
    p = p.copy()
    p[at] = best
    return p
