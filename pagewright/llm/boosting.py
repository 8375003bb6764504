"""Gradient boosted trees for two classes, in numpy, for small candidate tables."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of fixed depth on quantile bins, fitted to the log loss by Newton steps."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features; y: 0 or 1."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:])) for j in range(x.shape[1])]
        bins = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, bins)
        return self

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, leaf = np.zeros(inner, np.int32), np.full(inner, BINS, np.int32), np.zeros(inner + 1)
        node = np.zeros(len(g), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            if len(rows):
                feature[at], cut[at] = self._split(bins[rows], g[rows], h[rows])
            node[rows] = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
        for k in range(inner + 1):
            rows = node == inner + k
            leaf[k] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
        return feature, cut, leaf

    def _split(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = 1e-9, (0, BINS)
        whole_g, whole_h = g.sum(), h.sum()
        base = whole_g**2 / (whole_h + self.ridge)
        for j in range(bins.shape[1]):
            sg = np.cumsum(np.bincount(bins[:, j], g, BINS + 1))[:-1]
            sh = np.cumsum(np.bincount(bins[:, j], h, BINS + 1))[:-1]
            gain = sg**2 / (sh + self.ridge) + (whole_g - sg) ** 2 / (whole_h - sh + self.ridge) - base
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, k)
        return found

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not len(x):
            return np.zeros(0)
        bins = self._bin(x)
        margin = np.full(len(x), self.bias)
        for tree in self.trees:
            margin += self._walk(tree, bins)
        return 1 / (1 + np.exp(-margin))


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the share of class 1 is at least `precision`; above 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    good = hits >= precision * np.arange(1, len(s) + 1)
    last = np.append(s[1:] != s[:-1], True)
    ok = np.flatnonzero(good & last)
    return float(s[ok[-1]]) if len(ok) else 1.1
