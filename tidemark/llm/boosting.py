"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All nodes of all trees in one set of arrays; a leaf points to itself. `root` has one node per tree."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row, all trees at once, one level at a time."""
        if not len(self.root) or not len(x):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.root, (len(x), len(self.root)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: int = 5) -> Forest:
    """Fit P(y = 1) by logistic loss.

    monotone holds +1, -1 or 0 per feature: the prediction never falls, never rises, or is free as the feature
    grows. A split that would break its sign is not taken, and children of a constrained split are kept on
    their sides of its middle. Without rows, or with one class, the result is a constant.
    """
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)])
        flat = (binned + (np.arange(width) * bins)[:, None]).ravel()
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            _grow(nodes, roots, binned, flat, edges, y - p, p * (1 - p), monotone, depth, rate, bins, penalty, least, margin)
    columns = list(zip(*nodes)) if nodes else [[]] * 5
    kinds = (np.int32, float, np.int32, np.int32, float)
    return Forest(np.array(roots, np.int32), *(np.array(c, k) for c, k in zip(columns, kinds)), depth, base)


def _grow(nodes, roots, binned, flat, edges, grad, hess, monotone, depth, rate, bins, penalty, least, margin) -> None:
    width, n = binned.shape
    roots.append(len(nodes))

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    open_ = [(leaf(0.0), np.arange(n), -np.inf, np.inf)]
    for level in range(depth + 1):
        deeper = []
        for at, rows, low, high in open_:
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                cells = flat.reshape(width, n)[:, rows].ravel()
                many = lambda w: np.bincount(cells, None if w is None else np.tile(w, width), width * bins).reshape(width, bins).cumsum(1)
                gl, hl, cl = many(grad[rows]), many(hess[rows]), many(None)
                gr, hr, cr = g - gl, h - hl, len(rows) - cl
                vl, vr = np.clip(gl / (hl + penalty), low, high), np.clip(gr / (hr + penalty), low, high)
                gain = gl * vl - (hl + penalty) * vl**2 / 2 + gr * vr - (hr + penalty) * vr**2 / 2
                value = np.clip(g / (h + penalty), low, high)
                gain -= g * value - (h + penalty) * value**2 / 2
                gain[(cl < least) | (cr < least) | (monotone[:, None] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain.flat[k] > 1e-6:
                    best = divmod(k, bins)
            if best is None:
                nodes[at][4] = rate * float(np.clip(g / (h + penalty), low, high))
                margin[rows] += nodes[at][4]
                continue
            f, b = best
            goes = binned[f, rows] <= b
            middle = (vl[f, b] + vr[f, b]) / 2
            up = monotone[f]
            nodes[at][:4] = [f, float(edges[f][b]), leaf(0.0), leaf(0.0)]
            sides = ((low, min(high, middle)), (max(low, middle), high)) if up > 0 else ((max(low, middle), high), (low, min(high, middle))) if up < 0 else ((low, high), (low, high))
            deeper += [(nodes[at][2], rows[goes], *sides[0]), (nodes[at][3], rows[~goes], *sides[1])]
        open_ = deeper
