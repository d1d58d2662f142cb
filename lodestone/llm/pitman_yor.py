"""Seating in Pitman-Yor restaurants: Gibbs draws of a dish's tables given the other dishes' tables, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Up to this number of customers a dish's tables are drawn from their exact conditional distribution.
EXACT = 64


@lru_cache(maxsize=16)
def log_stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of discount d, for c and t up to EXACT: the weight of all ways to seat c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            t = np.arange(1, EXACT + 1)
            grow = np.log(np.maximum(c - d * t, 0.0)) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isnan(grow), -np.inf, grow))
    return out


def seat(c: np.ndarray, p0: np.ndarray, others: np.ndarray, d: float, r: np.random.Generator) -> np.ndarray:
    """Tables of each dish of c customers, drawn given the rest of its restaurant.

    others: strength plus discount times the other dishes' tables; p0: the parent's probability of the dish. Dishes of
    more than EXACT customers begin with such a draw; their other customers sit down in turn, in blocks that double,
    each block with the probability at its middle.
    """
    t = np.minimum(c, 1).astype(np.int64)
    small = np.minimum(c, EXACT)
    order = np.argsort(small, kind="stable")
    cut = np.searchsorted(small[order], np.arange(2, EXACT + 2))
    stirling = log_stirling(d)
    for k in range(2, EXACT + 1):
        at = order[cut[k - 2] : cut[k - 1]]
        if not len(at):
            continue
        tables = np.arange(1, k + 1)
        # S(k, t) p0^t times the product over the t tables of (others + discount * tables before); the first factor is common to all t.
        w = np.cumsum(np.log(others[at, None] + d * (tables - 1)) + np.log(p0[at, None]), 1) + stirling[k, 1 : k + 1]
        w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
        t[at] = 1 + (r.random(len(at))[:, None] * w[:, -1:] > w).sum(1)
    at, j = np.flatnonzero(c > EXACT), EXACT
    while len(at):
        m = np.minimum(j, c[at] - j)
        new = (others[at] + d * t[at]) * p0[at]
        t[at] += r.binomial(m, np.minimum(1.0, new / (new + np.maximum(j + m / 2 - d * t[at], 1e-9))))
        j *= 2
        at = at[c[at] > j]
    return np.minimum(t, c)


def seat_alike(c: np.ndarray, p0: float, others: float, d: float, r: np.random.Generator) -> np.ndarray:
    """seat() of dishes that differ in their customers only: one distribution for each number of customers."""
    t = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(np.minimum(c, EXACT), kind="stable")
    cut = np.searchsorted(np.minimum(c, EXACT)[order], np.arange(2, EXACT + 2))
    stirling = log_stirling(d)
    for k in range(2, EXACT + 1):
        at = order[cut[k - 2] : cut[k - 1]]
        if len(at):
            tables = np.arange(1, k + 1)
            w = np.cumsum(np.log(others + d * (tables - 1)) + np.log(p0)) + stirling[k, 1 : k + 1]
            w = np.cumsum(np.exp(w - w.max()))
            t[at] = 1 + np.searchsorted(w, r.random(len(at)) * w[-1], "right")
    more = np.flatnonzero(c > EXACT)
    t[more] = seat(c[more], np.full(len(more), p0), np.full(len(more), others), d, r)
    return np.minimum(t, c)


def sweep(room: np.ndarray, rooms: int, c: np.ndarray, fixed: np.ndarray, p0: np.ndarray, d: float, s: float, r: np.random.Generator, sweeps: int, burn: int, t: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean tables after burn-in, tables of the last sweep) of each dish.

    room[i]: the restaurant of dish i; fixed[room]: tables there that don't change (dishes of one customer, and those
    seated elsewhere). A sweep draws every other dish in turn of two halves, so that a draw sees the others' last tables.
    """
    t = np.minimum(c, 1).astype(np.int64) if t is None else t.copy()
    mean, half = np.zeros(len(c)), r.random(len(c)) < 0.5
    for k in range(sweeps):
        for part in (half, ~half):
            total = fixed + np.bincount(room, t, rooms)
            t[part] = seat(c[part], p0[part], s + d * np.maximum(total[room[part]] - t[part], 0), d, r)
        if k >= burn:
            mean += t
    return mean / max(1, sweeps - burn), t
