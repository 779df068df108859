"""Gradient-boosted trees for yes-or-no decisions, in numpy, small enough to ship with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """Complete trees of one depth, each as arrays in heap order."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss over quantile cuts of each feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    raw, inner = np.full(len(y), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = sigmoid(raw)
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            here = at == node
            if here.sum() >= 4:
                feature[node], threshold[node] = _best(binned[here], g[here], h[here], cuts, ridge)
            at[here] = 2 * node + 1 + (x[here, feature[node]] > threshold[node])
        leaf = np.array([rate * g[m].sum() / (h[m].sum() + ridge) for m in (at == inner + k for k in range(inner + 1))])
        raw += leaf[at - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def _best(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], ridge: float) -> tuple[int, float]:
    best, where = 1e-9, (0, np.inf)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], g, len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, len(c) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
        if gain.max() > best:
            best, where = gain.max(), (f, float(c[gain.argmax()]))
    return where


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn raw scores into probabilities, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        w = p * (1 - p) + 1e-9
        grad = np.array([((y - p) * raw).sum() - 1e-3 * a, (y - p).sum()])
        hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return a, b
