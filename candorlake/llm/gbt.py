"""Gradient-boosted trees for two classes, in numpy: shallow trees on binned features, logistic loss."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    #: Upper edges of each feature's bins but the last.
    edges: list[np.ndarray]
    #: Per tree, nodes in heap order: feature (-1: leaf), last bin that goes left, value.
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int


def _binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0) -> Forest:
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edges.append(values[:-1] if len(values) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    b = np.asfortranarray(_binned(edges, x))
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, size), -1), np.zeros((trees, size), dtype=int), np.zeros((trees, size))
    z = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=int)
        for n in range(size):
            own = np.flatnonzero(node == n)
            if not len(own):
                continue
            value[t, n] = rate * g[own].sum() / (h[own].sum() + ridge)
            if 2 * n + 2 >= size:
                continue
            best = (1e-6, -1, 0)
            whole = g[own].sum() ** 2 / (h[own].sum() + ridge)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(b[own, j], g[own], minlength=len(e) + 1))
                hs = np.cumsum(np.bincount(b[own, j], h[own], minlength=len(e) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[t, n], cut[t, n] = best[1:]
                node[own] = 2 * n + 1 + (b[own, best[1]] > best[2])
        z += value[t, node]
    return Forest(edges, feature, cut, value, start, depth)


def log_odds(f: Forest, x: np.ndarray) -> np.ndarray:
    b = _binned(f.edges, x)
    z = np.full(len(x), f.start)
    rows = np.arange(len(x))
    for feature, cut, value in zip(f.feature, f.cut, f.value):
        node = np.zeros(len(x), dtype=int)
        for _ in range(f.depth):
            j = feature[node]
            node = np.where(j < 0, node, 2 * node + 1 + (b[rows, j] > cut[node]))
        z += value[node]
    return z
