"""Gradient-boosted trees for two classes, over histograms, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """trees: for each, feature, bin and leaf value of the nodes of a full binary tree."""

    def __init__(self, edges: list[np.ndarray], base: float, depth: int):
        self.edges, self.base, self.depth = edges, base, depth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def _leaves(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        at, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return at

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += tree[2][self._leaves(tree, b)]
        return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(edges, float(np.log(mean / (1 - mean))), depth)
    b = model.binned(x)
    z, width, inner = np.full(len(y), model.base), bins + 1, 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64), np.zeros(2 * inner + 1)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            own = at - first
            gs, hs = np.bincount(own, g, n), np.bincount(own, h, n)
            for j in range(x.shape[1]):
                k = own * width + b[:, j]
                gl = np.bincount(k, g, n * width).reshape(n, width).cumsum(1)
                hl = np.bincount(k, h, n * width).reshape(n, width).cumsum(1)
                gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - (gs**2 / (hs + ridge))[:, None]
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best = np.where(better, gain[np.arange(n), top], best)
                feature[first : first + n][better], cut[first : first + n][better] = j, top[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        own = at - inner
        value[inner:] = rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + ridge)
        model.trees.append((feature, cut, value))
        z += value[at]
    return model
