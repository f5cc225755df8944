"""Gradient boosting of small trees over binned features, for samples of bounded size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees of one depth, as complete binary trees: a feature and an edge for each inner node, a value for each leaf."""

    start: float
    features: np.ndarray  # trees x inner nodes
    edges: np.ndarray  # trees x inner nodes; a row goes right where its feature is over the edge
    leaves: np.ndarray  # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, edge, leaf in zip(self.features, self.edges, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=int)
            while len(x) and node[0] < len(feature):  # all rows are on one level
                node = 2 * node + 1 + (x[row, feature[node]] > edge[node])
            out += leaf[node - len(feature)] if len(x) else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Boosted trees for the log loss, by Newton steps; x: rows x features, y: 0 or 1. Equal gains go to the first feature
    and edge, so that the same rows in the same order give the same trees."""
    rows, width = x.shape
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.quantile(c, quantiles, method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # bin > b means v > cut b
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(rows, start := float(np.log(base / (1 - base))))
    inner = 2**depth - 1
    features, edges, leaves = np.zeros((trees, inner), dtype=int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    place = binned + np.arange(width) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(rows, dtype=int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + place).ravel()
            g, h = (np.bincount(at, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS) for v in (grad, hess))
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            best = gain.reshape(count, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, cut = divmod(b, BINS)
                if gain[k].ravel()[b] > 1e-9 and cut < len(cuts[f]):
                    features[t, first + k], edges[t, first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(rows), features[t, node]] > edges[t, node])
        leaf = node - inner
        leaves[t] = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        margin += leaves[t][leaf]
    return Boosted(start, features, edges, leaves)


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits the rows, by Newton steps; targets are drawn in by the counts."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([1.0, 0.0])
    x = np.stack((margins, np.ones(len(y))), axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -1, 1)
    return float(w[0]), float(w[1])
