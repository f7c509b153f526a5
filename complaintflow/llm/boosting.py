"""Gradient-boosted trees for two classes, on numpy arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees of one depth as arrays: features and thresholds of inner nodes, values of leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (v.size - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are searched over quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(prior / (1 - prior)))
    score = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2 ** level - 1, 2 ** level
            gain, choice = np.zeros(n), [(0, np.inf)] * n
            for j, c in enumerate(cuts):
                key = (at - first) * BINS + binned[:, j]
                G = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(1)
                H = np.bincount(key, h, n * BINS).reshape(n, BINS).cumsum(1)
                left, right = G ** 2 / (H + ridge), (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + ridge)
                better = (left + right - G[:, -1:] ** 2 / (H[:, -1:] + ridge))[:, :len(c)]
                if better.shape[1]:
                    k = better.argmax(1)
                    for i in np.flatnonzero(better[np.arange(n), k] > gain + 1e-9):
                        gain[i], choice[i] = better[i, k[i]], (j, c[k[i]])
            for i, (j, c) in enumerate(choice):
                f[first + i], t[first + i] = j, c
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
        leaf = at - (2 ** depth - 1)
        v = rate * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + ridge)
        score += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)
