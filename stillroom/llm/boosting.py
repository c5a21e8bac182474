"""Gradient-boosted trees for a few classes, trained in memory on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays: a leaf has feature -1. A row goes left if its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            go_left = x[rows, f[rows]] <= self.threshold[at[rows]]
            at[rows] = np.where(go_left, self.left[at[rows]], self.right[at[rows]])


@dataclass
class Boosted:
    """One sequence of trees a class; scores are summed and turned into probabilities by a softmax with a fitted temperature and class offsets."""

    classes: int
    rate: float
    prior: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    temperature: float = 1.0
    offsets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.prior, (len(x), 1))
        for round_ in self.trees:
            for k, tree in enumerate(round_):
                out[:, k] += self.rate * tree.predict(x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x) / self.temperature + (0 if self.offsets is None else self.offsets)) if len(x) else np.zeros((0, self.classes))

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """The same trees with the temperature, and offsets of at most one, that give the held-out rows the least log loss."""
        raw = self.scores(x)
        best = (np.inf, 1.0, np.zeros(self.classes))
        for t in np.geomspace(0.25, 8, 31):
            offsets = np.zeros(self.classes)
            for _ in range(40):
                p = softmax(raw / t + offsets)
                step = np.bincount(y, minlength=self.classes) / len(y) - p.mean(axis=0)
                offsets = np.clip(offsets + 0.5 * step, -1, 1)
            loss = -np.log(np.maximum(softmax(raw / t + offsets)[np.arange(len(y)), y], 1e-12)).mean() + 0.002 * (offsets**2).sum()
            if loss < best[0]:
                best = (loss, float(t), offsets)
        return replace(self, temperature=best[1], offsets=best[2])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grow(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    """A regression tree on binned features: each split is the one that gains most by the second-order objective."""
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        nodes.append([-1, 0.0, -1, -1, g / (h + ridge)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, -1, -1)
        for f in range(bins.shape[1]):
            size = len(edges[f]) + 1
            if size < 2:
                continue
            b = bins[rows, f]
            gs, hs, ns = np.bincount(b, gradient[rows], size).cumsum()[:-1], np.bincount(b, hessian[rows], size).cumsum()[:-1], np.bincount(b, minlength=size).cumsum()[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        _, f, at = best
        if f >= 0:
            low = bins[rows, f] <= at
            left, right = add(rows[low], level + 1), add(rows[~low], level + 1)
            nodes[me][:4] = [f, float(edges[f][at]), left, right]
        return me

    add(np.arange(len(bins)), 0)
    a = list(zip(*nodes, strict=True))
    return Tree(np.array(a[0]), np.array(a[1], dtype=float), np.array(a[2]), np.array(a[3]), np.array(a[4], dtype=float))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 50, rate: float = 0.2, depth: int = 4, least: int = 4, ridge: float = 1.0, bins: int = 64) -> Boosted:
    """Softmax boosting; rows weigh alike. Deterministic."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    model = Boosted(classes, rate, np.zeros(classes))
    scores, target = np.zeros((len(x), classes)), np.eye(classes)[y]
    for _ in range(rounds):
        p = softmax(scores)
        round_ = [grow(binned, edges, target[:, k] - p[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6), depth, least, ridge) for k in range(classes)]
        for k, tree in enumerate(round_):
            scores[:, k] += rate * tree.predict(x)
        model.trees.append(round_)
    return model
