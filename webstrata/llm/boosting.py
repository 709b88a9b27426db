"""Gradient-boosted regression trees for yes/no labels, in numpy.

Features are cut into bins once; a tree grows level by level, each node taking the split with the best gain of
gradient and curvature sums. Models are small (trees x 2^depth numbers) and travel with the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """`feature` and `above` of the inner nodes of every tree, level by level, and the values of the leaves."""
    base: float
    feature: np.ndarray
    above: np.ndarray
    leaves: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, above, leaves in zip(self.feature, self.above, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            out += leaves[node - (len(feature))]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boost on the log loss. Labels of one kind only give a constant."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    base, inner = float(np.log(share / (1 - share))), 2 ** depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, found = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        feature, above, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2 ** level - 1, 2 ** level
            best = np.zeros(wide)
            place = node - first
            total_g, total_h = (np.bincount(place, w, wide) for w in (gradient, curve))
            whole = total_g ** 2 / (total_h + ridge)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = place * (len(e) + 1) + binned[:, j]
                g, h = (np.bincount(cell, w, wide * (len(e) + 1)).reshape(wide, -1).cumsum(1)[:, :-1] for w in (gradient, curve))
                gain = g ** 2 / (h + ridge) + (total_g[:, None] - g) ** 2 / (total_h[:, None] - h + ridge) - whole[:, None]
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feature[first + k], above[first + k] = top[k], j, e[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > above[node])
        leaf = node - inner
        values = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        margin += values[leaf]
        for store, value in zip(found, (feature, above, values)):
            store.append(value)
    return Trees(base, *(np.array(f) for f in found), depth)


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50, counts: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, offset) that turn margins into probabilities, fitted with smoothed labels by Newton steps.

    With `counts`, an entry stands for so many rows.
    """
    counts = np.ones(len(y)) if counts is None else counts
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    high, low = ((counts * y).sum() + 1) / ((counts * y).sum() + 2), 1 / ((counts * (1 - y)).sum() + 2)
    target, weights = np.where(y > 0, high, low), np.array([1.0, 0.0])
    design = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ weights))
        step = np.linalg.solve((design * (counts * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (counts * (target - p)))
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), float(weights[1])
