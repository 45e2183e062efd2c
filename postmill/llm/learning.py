"""Small numpy learners on bounded samples: hashed features, regularised linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text (null as empty) falls on `fold` of `folds`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch steps scaled per parameter by a running mean of squared gradients (Adam)."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200, rate: float = 0.05, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (features + 1, outputs) of logistic regressions of the columns of `y` (0 or 1) on `x`."""
    ones = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = (np.ones(len(x)) / len(x) if weight is None else weight / weight.sum())[:, None].astype(x.dtype)

    def gradient(w):
        g = ones.T @ ((sigmoid(ones @ w) - y) * share)
        g[:-1] += l2 * w[:-1]
        return g

    return descend(gradient, np.zeros((ones.shape[1], y.shape[1]), x.dtype), steps, rate)
