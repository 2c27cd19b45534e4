"""Gradient-boosted trees over dense features, and isotonic calibration, for samples of bounded size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Logistic loss, histogram splits, second-order leaf values. A node is (feature, cut, left, right) or a value;
    rows with feature <= cut go left."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    least: int = 8
    ridge: float = 1.0
    start: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            tree = self._grow(binned, cuts, grad, hess, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._apply(tree, x)
        return self

    def _grow(self, binned, cuts, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(-self.rate * g / (h + self.ridge))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.bincount(b, w, len(c) + 1).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            return leaf
        left = binned[rows, f] <= k
        return (f, float(cuts[f][k]), self._grow(binned, cuts, grad, hess, rows[left], depth - 1), self._grow(binned, cuts, grad, hess, rows[~left], depth - 1))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        return np.where(x[:, f] <= cut, self._apply(left, x), self._apply(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._apply(t, np.asarray(x, float)) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The margin as a built-in expression."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(features[f] <= F.lit(cut), of(left)).otherwise(of(right))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + of(t)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on score, by pooling adjacent violators."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(score[order], np.asarray(y, float)[order], strict=True):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            v2, n2, _, last = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    knots = [(x, v / n) for v, n, a, b in blocks for x in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
