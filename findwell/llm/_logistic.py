"""Logistic regression with L1 or L2 penalty in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean log loss + penalty * sum |w|, by accelerated proximal gradient steps."""
    n, m = x.shape
    w, b = np.zeros(m), 0.0
    if not n:
        return w, b
    rate = y.mean()
    b = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    # the curvature of the mean log loss is at most a quarter of the largest eigenvalue
    v = np.ones(m + 1) / np.sqrt(m + 1)
    full = np.c_[x, np.ones(n)]
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 4.0 * n / max(np.linalg.norm(full @ v) ** 2, 1e-9)
    at = np.r_[w, b]
    look, t = at.copy(), 1.0
    for _ in range(steps):
        grad = full.T @ (sigmoid(full @ look) - y) / n
        new = look - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t2 * (new - at)
        if np.abs(new - at).max() < 1e-7:
            at = new
            break
        at, t = new, t2
    return at[:-1], float(at[-1])


def ridge_sparse(begins: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray, steps: int = 300, most: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights and intercept of least weighted mean log loss + penalty / 2 * |w|^2, by accelerated gradient steps.

    Row k has the columns cols[begins[k] : begins[k + 1]], each with its column's
    scale as value. About `most` entries are worked on at a time.
    """
    n, m = len(begins) - 1, len(scale)
    at = np.zeros(m + 1)
    total = weight.sum()
    if not n or total <= 0:
        return at[:-1], 0.0
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begins, begins[cuts[-1]] + most, side="right")) - 1))
    sizes = np.diff(begins)

    def times(w):
        own, out = scale * w[:m], np.full(n, w[m])
        for a, b in zip(cuts, cuts[1:]):
            some = a + np.flatnonzero(sizes[a:b])
            if len(some):
                out[some] += np.add.reduceat(own[cols[begins[a] : begins[b]]], begins[some] - begins[a])
        return out

    def back(r):
        g = np.zeros(m)
        for a, b in zip(cuts, cuts[1:]):
            g += np.bincount(cols[begins[a] : begins[b]], weights=np.repeat(r[a:b], sizes[a:b]), minlength=m)
        return np.r_[g * scale, r.sum()]

    v = np.ones(m + 1)
    top = 1.0
    for _ in range(20):
        v = back(weight / total * times(v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    step = 1.0 / (0.25 * 1.1 * top + penalty)
    look, t = at.copy(), 1.0
    for _ in range(steps):
        grad = back(weight / total * (sigmoid(times(look)) - y))
        grad[:m] += penalty * look[:m]
        new = look - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t2 * (new - at)
        if np.abs(new - at).max() < 1e-6:
            at = new
            break
        at, t = new, t2
    return at[:-1], float(at[-1])
