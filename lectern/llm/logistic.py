"""A small logistic model for bounded samples of features."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, whole: dict[int, int] | None = None, ridge: float = 1.0, rounds: int = 40) -> tuple[float, ...]:
    """Means, deviations, weights and intercept, by Newton steps. whole: rows of each class that the sample stands for.

    Without rows of both classes all weights are 0 and the intercept is that of a share of 1/100 or 99/100.
    """
    k = x.shape[1]
    if len(set(y.tolist())) < 2:
        return (*[0.0] * k, *[1.0] * k, *[0.0] * k, 4.6 if len(y) and y[0] else -4.6)
    mean, dev = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / dev, np.ones(len(x))]
    share = np.ones(len(x))
    for c, n in (whole or {}).items():
        share[y == c] = n / max(1, (y == c).sum())
    share /= share.mean()
    w = np.zeros(k + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + ridge * np.eye(k + 1), a.T @ (share * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return (*mean.tolist(), *dev.tolist(), *w.tolist())


def probability(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    k = x.shape[1]
    mean, dev, w = np.array(curve[:k]), np.array(curve[k : 2 * k]), np.array(curve[2 * k :])
    return 1 / (1 + np.exp(-np.clip((x - mean) / dev @ w[:k] + w[k], -30, 30)))
