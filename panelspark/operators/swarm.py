"""Portfolio search by particle swarm and by ant colony over one date's candidates, for use in backtest.allocate.

Both maximise mean - risk * variance - move * turnover over long-only weights that sum to one with a cap, from a fixed
seed. They are heuristics: the result is feasible and at least as good as equal weights, not the optimum.
"""

from __future__ import annotations

import numpy as np


def project(w: np.ndarray, cap: float) -> np.ndarray:
    """Nearest weights of at least 0, at most cap (or 1 / n if that is more), with sum 1."""
    cap = max(cap, 1.0 / len(w))
    lo, hi = w.min() - 1.0, w.max()
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(w - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(w - hi, 0, cap)


def score(w: np.ndarray, mean: np.ndarray, cov: np.ndarray, before: np.ndarray, risk: float, move: float) -> float:
    return float(w @ mean - risk * (w @ cov @ w) - move * np.abs(w - before).sum() / 2)


def particle_swarm(history: np.ndarray, cap: float = 0.3, risk: float = 5.0, move: float = 0.0005, particles: int = 24, rounds: int = 40, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    n = history.shape[1]
    mean, cov = history.mean(0), np.atleast_2d(np.cov(history, rowvar=False))
    even = np.full(n, 1.0 / n)
    x = np.stack([even, *(project(rng.dirichlet(np.ones(n)), cap) for _ in range(particles - 1))])
    v = np.zeros_like(x)
    value = np.array([score(w, mean, cov, even, risk, move) for w in x])
    own, own_value = x.copy(), value.copy()
    for _ in range(rounds):
        best = own[own_value.argmax()]
        a, b = rng.random((2, particles, 1))
        v = 0.7 * v + 1.4 * a * (own - x) + 1.4 * b * (best - x)
        x = np.stack([project(w, cap) for w in x + v])
        value = np.array([score(w, mean, cov, even, risk, move) for w in x])
        better = value > own_value
        own[better], own_value[better] = x[better], value[better]
    return own[own_value.argmax()]


def ant_colony(history: np.ndarray, cap: float = 0.3, risk: float = 5.0, move: float = 0.0005, ants: int = 24, rounds: int = 30, buckets: int = 5, keep: float = 0.8, seed: int = 42) -> np.ndarray:
    """Each ant draws a bucket (a multiple of a unit of weight) per candidate, by trail times merit; the best quarter renews the trail."""
    rng = np.random.default_rng(seed)
    n = history.shape[1]
    mean, cov = history.mean(0), np.atleast_2d(np.cov(history, rowvar=False))
    even = np.full(n, 1.0 / n)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    merit = np.exp(np.clip(mean / dev, -2, 2))[:, None] ** np.linspace(-0.5, 0.5, buckets)
    trail = np.ones((n, buckets))
    best, best_value = even, score(even, mean, cov, even, risk, move)
    for _ in range(rounds):
        p = trail * merit
        p = np.cumsum(p / p.sum(1, keepdims=True), axis=1)
        drawn = (rng.random((ants, n, 1)) > p[None]).sum(2).clip(0, buckets - 1)
        w = np.stack([project(d / d.sum(), cap) if d.sum() else even for d in drawn.astype(float)])
        value = np.array([score(u, mean, cov, even, risk, move) for u in w])
        order = np.argsort(-value)
        if value[order[0]] > best_value:
            best, best_value = w[order[0]], value[order[0]]
        trail *= keep
        for rank, i in enumerate(order[: max(1, ants // 4)]):
            trail[np.arange(n), drawn[i]] += 1.0 / (rank + 1)
    return best
