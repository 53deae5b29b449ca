"""Gradient-boosted trees for two classes, in numpy: small tables, logistic loss, exact splits."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """An additive model of regression trees of fixed depth, kept as arrays."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.base = 0.0
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            z += self._grow(x, p - y, p * (1 - p))
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        inner = 2**self.depth - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows):
                feature[node], cut[node] = self._split(x[rows], g[rows], h[rows])
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for k in range(inner + 1):
            rows = at == inner + k
            leaf[k] = -self.rate * g[rows].sum() / (h[rows].sum() + self.least)
        self.feature.append(feature)
        self.cut.append(cut)
        self.leaf.append(leaf)
        return leaf[at - inner]

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, found = g.sum() ** 2 / (h.sum() + self.least) + 1e-9, (0, np.inf)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
            ok = np.flatnonzero(v[1:] > v[:-1])
            if not len(ok):
                continue
            gain = gs[ok] ** 2 / (hs[ok] + self.least) + (gs[-1] - gs[ok]) ** 2 / (hs[-1] - hs[ok] + self.least)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, (v[ok[k]] + v[ok[k] + 1]) / 2)
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-z))
