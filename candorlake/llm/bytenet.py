"""A small convolutional network over bytes, in numpy: multi-width filters, max pooling, softmax.

A filter of width w adds up one weight per byte at each of its w places; its largest value over a row of
bytes is a feature. As the input is bytes, the sums are looked up: tables over pairs of bytes (65,536
rows) replace the multiplications.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np


class Network(NamedTuple):
    #: One array (width, 256, filters) for each width.
    weights: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


class Scorer:
    """A network with its lookup tables."""

    def __init__(self, net: Network):
        self.net = net
        self._tables = []
        for w in net.weights:
            pairs = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(w) - 1, 2)]
            self._tables.append((pairs, w[-1] if len(w) % 2 else None))

    def maps(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """(rows, places, filters) for each width; x: (rows, bytes) of uint8."""
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        for (pairs, last), w in zip(self._tables, self.net.weights):
            places = x.shape[1] - len(w) + 1
            out = np.take(pairs[0], pair[:, :places], axis=0)
            for j, t in enumerate(pairs[1:], 1):
                out += np.take(t, pair[:, 2 * j : 2 * j + places], axis=0)
            if last is not None:
                out += np.take(last, x[:, len(w) - 1 :], axis=0)
            yield out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([m.max(axis=1) for m in self.maps(x)], axis=1)
        return softmax(np.maximum(h + self.net.bias, 0) @ self.net.dense + self.net.dense_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(draw: Callable[[np.ndarray, np.random.Generator], np.ndarray], labels: np.ndarray, classes: int, widths: tuple[int, ...], filters: int, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Trains with Adam. draw: row numbers -> bytes of those rows, which may differ from call to call."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths]
    bias = np.zeros(len(widths) * filters, dtype=np.float32)
    dense = rng.normal(0, 0.3, (len(bias), classes)).astype(np.float32)
    dense_bias = np.zeros(classes, dtype=np.float32)
    every = [*params, bias, dense, dense_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in every]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = draw(rows, rng)
            h, best = [], []
            for m in _plain_maps(params, x):
                best.append(m.argmax(axis=1))
                h.append(np.take_along_axis(m, best[-1][:, None, :], axis=1)[:, 0])
            h = np.concatenate(h, axis=1) + bias
            p = softmax(np.maximum(h, 0) @ dense + dense_bias)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = (p @ dense.T) * (h > 0)
            grads = []
            for k, w in enumerate(widths):
                g = np.zeros_like(params[k])
                own = back[:, k * filters : (k + 1) * filters]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, best[k] + j, axis=1), np.arange(filters)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), np.maximum(h, 0).T @ p, p.sum(axis=0)]
            step += 1
            now = rate * (1 - epoch / epochs)
            for q, g, (m1, m2) in zip(every, grads, moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= (now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(params, bias, dense, dense_bias)


def _plain_maps(weights: list[np.ndarray], x: np.ndarray) -> Iterator[np.ndarray]:
    for w in weights:
        places = x.shape[1] - len(w) + 1
        out = np.take(w[0], x[:, :places], axis=0)
        for j in range(1, len(w)):
            out += np.take(w[j], x[:, j : j + places], axis=0)
        yield out
