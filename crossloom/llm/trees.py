"""Small histogram trees in numpy, shared by the URL filter and the quality classifier."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 48


@dataclass
class Tree:
    """feature (-1: leaf), threshold (left: value <= threshold), left, right, value of each node; node 0 is the root."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return np.array(self.value)[node]
            n = node[inner]
            node[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])

    def paths(self) -> list[list[tuple[int, bool, float]]]:
        """Conditions (feature, at most?, threshold) that lead to each node but the root."""
        out, todo = [], [(0, [])]
        while todo:
            node, path = todo.pop()
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = self.feature[node], self.threshold[node]
                todo += [(self.left[node], [*path, (f, True, t)]), (self.right[node], [*path, (f, False, t)])]
        return out


def cuts(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds of each column: midpoints between quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS), method="nearest"))
        out.append((v[:-1] + v[1:]) / 2)
    return out


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, min_rows: int, l2: float = 1.0) -> Tree:
    """Second-order regression tree over binned columns."""
    tree = Tree()

    def split(rows: np.ndarray, node: int, depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * min_rows:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(n < min_rows) | (len(rows) - n < min_rows)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] < 0:
            return
        _, j, k = best
        tree.feature[node], tree.threshold[node] = j, float(edges[j][k])
        goes = binned[rows, j] <= k
        for side, part in (("left", rows[goes]), ("right", rows[~goes])):
            child = tree.add(float(-grad[part].sum() / (hess[part].sum() + l2)))
            getattr(tree, side)[node] = child
            split(part, child, depth - 1)

    tree.add(float(-grad[rows].sum() / (hess[rows].sum() + l2)))
    split(rows, 0, depth)
    return tree


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, min_rows: int = 10, share: float = 0.7, seed: int = 1, columns: float = 1.0) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting: (start, trees); the log odds are start + rate * sum of the trees' values. Each tree sees a share of the rows and of the columns."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(p / (1 - p)))
    edges = cuts(x)
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(1, int(share * len(y))), replace=False))
        seen = edges if columns >= 1 else [e if j in some else e[:0] for some in [set(rng.choice(len(edges), max(1, int(columns * len(edges))), replace=False).tolist())] for j, e in enumerate(edges)]
        t = grow(binned, seen, q - y, q * (1 - q), rows, depth, min_rows)
        z += rate * t.predict(x)
        out.append(t)
    return start, out
