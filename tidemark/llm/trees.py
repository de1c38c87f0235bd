"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal; isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Cells of (row, tree) that are traversed at once.
CELLS = 2_000_000
#: Rows in the first pools of a calibration, and rows of the overall share that each pool counts besides its own.
LEAST_POOL, PRIOR = 20, 10


@dataclass
class Forest:
    """All trees in one set of node arrays. A leaf points to itself, so every row takes `depth` steps in every tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        step = max(1, CELLS // max(1, len(self.roots)))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[i : i + step] = self.bias + self.value[node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least_hessian: float = 3.0
) -> Forest:
    """Logistic boosting over quantile bins; deterministic. With no rows, or one class only, the bias stands alone."""
    n, width = x.shape
    share = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    nodes: list[tuple] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], 1)
        cells = binned + np.arange(width) * bins
        score = np.full(n, bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            score += _grow(cells, binned, y - p, np.maximum(p * (1 - p), 1e-9), edges, bins, depth, rate, l2, least_hessian, nodes, roots)
    if not nodes:
        nodes, roots, depth = [(0, 0.0, 0, 0, 0.0)], [0], 1
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Forest(feature.astype(np.int32), threshold, left.astype(np.int32), right.astype(np.int32), value, np.array(roots, np.int32), depth, bias)


def _grow(cells, binned, g, h, edges, bins, depth, rate, l2, least, nodes, roots) -> np.ndarray:
    """Add one tree, level by level; what it adds to each row's score."""
    n, width = cells.shape
    at = np.zeros(n, np.int64)  # the open node of each row; -1 once it is in a leaf
    out = np.zeros(n)
    roots.append(len(nodes))
    nodes.append(None)
    level = [roots[-1]]
    for d in range(depth + 1):
        size = width * bins
        rows = np.flatnonzero(at >= 0)
        key = (at[rows, None] * size + cells[rows]).ravel()
        shape = (len(level), width, bins)
        sum_g = np.bincount(key, np.repeat(g[rows], width), len(level) * size).reshape(shape)
        sum_h = np.bincount(key, np.repeat(h[rows], width), len(level) * size).reshape(shape)
        all_g, all_h = sum_g[:, 0].sum(1), sum_h[:, 0].sum(1)
        left_g, left_h = sum_g.cumsum(2), sum_h.cumsum(2)
        right_g, right_h = all_g[:, None, None] - left_g, all_h[:, None, None] - left_h
        gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (all_g**2 / (all_h + l2))[:, None, None]
        gain[(left_h < least) | (right_h < least)] = -np.inf
        for f in range(width):
            gain[:, f, len(edges[f]) :] = -np.inf
        best = gain.reshape(len(level), -1).argmax(1)
        following: list[int] = []
        move = at.copy()
        for i, node in enumerate(level):
            f, b = divmod(int(best[i]), bins)
            mine = rows[at[rows] == i]
            if d == depth or not gain[i, f, b] > 1e-6:
                v = rate * all_g[i] / (all_h[i] + l2)
                nodes[node] = (0, 0.0, node, node, float(v))
                out[mine] = v
                move[mine] = -1
                continue
            a = len(nodes)
            nodes.extend((None, None))
            nodes[node] = (f, float(edges[f][b]), a, a + 1, 0.0)
            move[mine] = np.where(binned[mine, f] <= b, len(following), len(following) + 1)
            following.extend((a, a + 1))
        at, level = move, following
        if not level:
            break
    return out


@dataclass
class Isotonic:
    """A monotone map of scores by pooling adjacent violators, linear between the pools.

    Pools start at LEAST_POOL rows and count PRIOR more of the overall share, so that a few rows claim little.
    """

    x: np.ndarray
    y: np.ndarray

    @staticmethod
    def fit(score: np.ndarray, label: np.ndarray) -> Isotonic:
        if not len(score):
            return Isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []
        for part in np.array_split(order, max(1, len(order) // LEAST_POOL)):
            pools.append([float(label[part].sum()), float(len(part)), float(score[part].sum())])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                b = pools.pop()
                for k in range(3):
                    pools[-1][k] += b[k]
        share = float(label.mean())
        y = np.array([(p[0] + PRIOR * share) / (p[1] + PRIOR) for p in pools])
        return Isotonic(np.array([p[2] / p[1] for p in pools]), np.maximum.accumulate(y))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        """A hundredth of the score itself stays in, so that order inside a pool isn't lost."""
        return 0.99 * np.interp(score, self.x, self.y) + 0.01 * score
