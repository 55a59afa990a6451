"""Gradient-boosted trees for binary labels: histogram splits, logistic loss, Platt-calibrated scores."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Small boosted trees over a dense matrix; deterministic."""

    def __init__(self, trees=60, depth=4, rate=0.2, bins=32, min_leaf=5, l2=1.0):
        self.trees_n, self.depth, self.rate, self.bins, self.min_leaf, self.l2 = trees, depth, rate, bins, min_leaf, l2
        self.trees: list = []
        self.base, self.scale, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def _bin(self, X):
        return np.column_stack([np.searchsorted(c, X[:, f], side="right") for f, c in enumerate(self.cuts)]).astype(np.int64)

    def fit(self, X, y, weight=None):
        y = y.astype(float)
        w = np.ones(len(y)) if weight is None else weight
        self.cuts = []
        for f in range(X.shape[1]):
            u = np.unique(X[:, f])
            self.cuts.append((u[1:] + u[:-1]) / 2 if len(u) <= self.bins else np.unique(np.quantile(X[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])))
        B = self._bin(X)
        p = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
        self.base = np.log(p / (1 - p))
        score = np.full(len(y), self.base)
        for _ in range(self.trees_n):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(B, (y - q) * w, np.maximum(q * (1 - q), 1e-6) * w)
            self.trees.append(tree)
            score += self._apply(tree, B)
        return self

    def _grow(self, B, g, h):
        feature, cut, left, right, value = [], [], [], [], []

        def node(idx, depth):
            k = len(feature)
            for a in (feature, cut, left, right):
                a.append(-1)
            G, H = g[idx].sum(), h[idx].sum()
            value.append(self.rate * G / (H + self.l2))
            if depth == 0 or len(idx) < 2 * self.min_leaf:
                return k
            best, parent = (1e-6, -1, -1), G * G / (H + self.l2)
            for f in range(B.shape[1]):
                n = len(self.cuts[f]) + 1
                if n < 2:
                    continue
                b = B[idx, f]
                cg, ch, cn = np.cumsum(np.bincount(b, g[idx], n))[:-1], np.cumsum(np.bincount(b, h[idx], n))[:-1], np.cumsum(np.bincount(b, minlength=n))[:-1]
                gain = cg**2 / (ch + self.l2) + (G - cg) ** 2 / (H - ch + self.l2) - parent
                gain[(cn < self.min_leaf) | (len(idx) - cn < self.min_leaf)] = -1
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], f, j)
            if best[1] < 0:
                return k
            feature[k], cut[k] = best[1], best[2]
            m = B[idx, best[1]] <= best[2]
            left[k] = node(idx[m], depth - 1)
            right[k] = node(idx[~m], depth - 1)
            return k

        node(np.arange(len(g)), self.depth)
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def _apply(self, tree, B):
        feature, cut, left, right, value = tree
        at = np.zeros(len(B), np.int64)
        rows = np.arange(len(B))
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            down = np.where(B[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at])
            at = np.where(go, down, at)
        return value[at]

    def raw(self, X):
        if not len(X):
            return np.zeros(0)
        B = self._bin(X)
        return np.full(len(X), self.base) + sum(self._apply(t, B) for t in self.trees)

    def calibrate(self, X, y):
        """Platt scaling on held-out rows, and the threshold with the best F1 there (the middle of the best range)."""
        s, y = self.raw(X), y.astype(float)
        if len(np.unique(y)) < 2:
            return self
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((p - y) * s).sum() + 1e-2 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale, self.shift = max(a, 1e-3), b
        p = self.predict(X)
        grid = np.linspace(0.02, 0.98, 97)
        tp = np.array([((p >= t) & (y == 1)).sum() for t in grid])
        f1 = 2 * tp / np.maximum(1, np.array([(p >= t).sum() for t in grid]) + y.sum())
        self.threshold = float(np.median(grid[f1 >= f1.max() - 1e-9]))
        return self

    def predict(self, X):
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(X) + self.shift, -30, 30)))
