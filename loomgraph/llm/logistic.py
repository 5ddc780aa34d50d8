"""Logistic regression on a few standardised features, by Newton's method."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.1, rounds: int = 40) -> Logistic:
    """Rows count by their weights. Without both labels the constant score is the share of label 1."""
    weight = np.ones(len(y)) if weight is None or not len(y) else weight / weight.mean()
    if not len(x) or y.min() == y.max():
        w = np.zeros(x.shape[1] + 1)
        w[-1] = 40.0 if len(y) and y.max() > 0 else -40.0 if len(y) else 0.0
        return Logistic(np.zeros(x.shape[1]), np.ones(x.shape[1]), w)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = np.r_[np.full(a.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (weight * (y - p)) - keep * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)
