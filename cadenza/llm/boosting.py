"""Gradient-boosted regression trees on logistic loss over a bounded sample of binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: for each inner node a feature and a cut, for each leaf a value."""

    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1e-6) -> Trees:
    """Newton boosting with histogram splits. With no rows, or one label only, the model is constant."""
    n, m = x.shape
    pos = float(y.sum())
    model = Trees(float(np.log((pos + 0.5) / (n - pos + 0.5))), depth)
    if not 0 < pos < n:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    z, inner = np.full(n, model.base), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, cut, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins + 1)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain = np.full(count, least)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                width = len(cuts[j]) + 1
                at = (node - first) * width + binned[:, j]
                gs, hs = (np.bincount(at, w, count * width).reshape(count, width).cumsum(axis=1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                s = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                best = s[:, :-1].argmax(axis=1)
                value = s[np.arange(count), best]
                better = value > gain
                gain[better] = value[better]
                k = np.flatnonzero(better)
                feature[first + k], cut[first + k], cut_bin[first + k] = j, cuts[j][best[k]], best[k]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut_bin[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        z = z + leaf[leaf_of]
        model.trees.append((feature, cut, leaf))
    return model


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold from which on the given scores reach the precision; infinity if none does."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((hits >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else float("inf")
