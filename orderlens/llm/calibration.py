"""Isotonic calibration from binned scores."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of positive / n over x (pool adjacent violators)."""
    pools: list[list[float]] = []  # n, positive, sum of x * n
    for a, b, c in zip(x[np.argsort(x)], n[np.argsort(x)], positive[np.argsort(x)]):
        pools.append([b, c, a * b])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    # a half row of either label keeps the ends off 0 and 1
    return np.array([p[2] / p[0] for p in pools]), np.array([(p[1] + 0.5 * (p[1] / p[0])) / (p[0] + 0.5) for p in pools])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray], low: float, high: float) -> np.ndarray:
    """Scores in 0..1 that follow the knots and stay in the order of ``raw`` where these are level."""
    fit = np.interp(raw, *knots)
    order = np.clip((raw - low) / max(high - low, 1e-9), 0, 1)
    return np.clip(0.98 * fit + 0.02 * order, 0, 1)
