"""Gradient-boosted trees for two classes: Newton steps on logistic loss over binned features."""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """Complete binary trees over bins: ``feature`` and ``above`` per inner node, ``leaf`` values, ``edges`` of the bins."""

    def __init__(self, edges: list[np.ndarray], depth: int, base: float):
        self.edges, self.depth, self.base = edges, depth, base
        self.feature: list[np.ndarray] = []
        self.above: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.base)
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            out += leaf[self._place(bins, feature, above)]
        return out

    def _place(self, bins: np.ndarray, feature: np.ndarray, above: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            node = 2 * node + 1 + (bins[rows, feature[node]] > above[node])
        return node - (2**self.depth - 1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 2.0, least: int = 12) -> Trees:
    """``y`` holds 0 and 1. The same rows give the same trees."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = Trees(edges, depth, float(np.log(share / (1 - share))))
    if not len(x):
        return model
    bins, margin = model.binned(x), np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, above = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for k in range(x.shape[1]):
                at = node * BINS + bins[:, k]
                sums = [np.bincount(at, w, n * BINS).reshape(n, BINS).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, cl), (gt, ht, ct) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(n), cut]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better], above[first : first + n][better] = k, cut[better]
            at = node + first
            node = 2 * node + (bins[np.arange(len(x)), feature[at]] > above[at])
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
        margin += leaf[node]
        model.feature.append(feature)
        model.above.append(above)
        model.leaf.append(leaf)
    return model
