"""Logistic regression with an L1 penalty, for models that are fitted on bounded samples."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Sparse(NamedTuple):
    """A 0/1 matrix by rows: the columns of row i are columns[bounds[i]:bounds[i + 1]]."""

    bounds: np.ndarray
    columns: np.ndarray
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.columns])])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(r, np.diff(self.bounds)), self.width)

    def rows(self, keep: np.ndarray) -> Sparse:
        chosen = np.repeat(keep, np.diff(self.bounds))
        return Sparse(np.concatenate([[0], np.cumsum(np.diff(self.bounds)[keep])]), self.columns[chosen], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso_logistic(x: Sparse | np.ndarray, y: np.ndarray, penalty: float, dense: np.ndarray | None = None, steps: int = 300) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, weights of x and weights of the dense columns, by accelerated proximal gradient steps.

    The intercept is free of the penalty. With one class only, the weights are 0.
    """
    n = len(y)
    width = x.width if isinstance(x, Sparse) else x.shape[1]
    dense = np.zeros((n, 0)) if dense is None else dense
    m = dense.shape[1]
    share = (y.sum() + 0.5) / (n + 1)
    start = np.concatenate([[np.log(share / (1 - share))], np.zeros(width + m)])
    if not n or y.min() == y.max():
        return float(start[0]), start[1 : 1 + width], start[1 + width :]
    times = x.times if isinstance(x, Sparse) else (lambda w: x @ w)
    transposed = x.transposed_times if isinstance(x, Sparse) else (lambda r: x.T @ r)

    def forward(v: np.ndarray) -> np.ndarray:
        return v[0] + times(v[1 : 1 + width]) + dense @ v[1 + width :]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.concatenate([[r.sum()], transposed(r), dense.T @ r]) / n

    # largest eigenvalue by power steps bounds the curvature
    v = np.ones(len(start))
    for _ in range(12):
        v = backward(forward(v / np.linalg.norm(v)))
    rate = 4 / max(np.linalg.norm(v), 1e-9) / 1.1
    w, ahead, t = start, start, 1.0
    for _ in range(steps):
        new = ahead - rate * backward(sigmoid(forward(ahead)) - y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1 : 1 + width], w[1 + width :]
