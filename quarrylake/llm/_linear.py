"""Hashed sparse features and a softmax regression trained by follow-the-regularised-leader with elastic-net penalties."""

from __future__ import annotations

import numpy as np

from quarrylake.llm._text import mix

_U = np.uint64


def hashed_grams(codes: np.ndarray, n: int, log2_dims: int) -> np.ndarray:
    """The bucket of each run of n codes, by its start."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    m = len(codes) - n + 1
    h = np.full(m, _U(0x9E3779B97F4A7C15 * n & (1 << 64) - 1))
    for j in range(n):
        h = (h ^ codes[j : j + m]) * _U(0x100000001B3)
    h = h * _U(0x9E3779B97F4A7C15)
    return ((h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93) >> _U(64 - log2_dims)).astype(np.int64)


def counted(buckets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, how often)."""
    if len(buckets) < dims // 16:
        return np.unique(buckets, return_counts=True)
    c = np.bincount(buckets, minlength=dims)
    at = np.flatnonzero(c)
    return at, c[at]


def weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    """(1 + log count) times idf, of length 1."""
    x = 1 + np.log(n)
    if idf is not None:
        x = x * idf[at]
    return x / max(1e-12, float(np.sqrt((x * x).sum())))


class Ftrl:
    """Softmax weights over hashed features. Of two classes only the second's weights are kept: the first's are their negatives."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.two = classes == 2
        shape = (dims,) if self.two else (dims, classes)
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (np.clip(z, -self.l1, self.l1) - z) / ((self.beta + root) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        w = self._weights(self.z, np.sqrt(self.n))
        return np.stack([-w, w], axis=1) if self.two else w

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 3, seed: int = 7, scale: np.ndarray | None = None, heft: np.ndarray | None = None) -> np.ndarray:
        """rows: (buckets, values); y: a probability of each class; scale: of each bucket's values; heft: how much each row counts.
        Gives the weights."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                if scale is not None:
                    x = x * scale[at]
                    on = np.flatnonzero(x)
                    at, x = at[on], x[on]
                z, n = self.z[at], self.n[at]
                root = np.sqrt(n)
                w = self._weights(z, root)
                if self.two:
                    g = x * (1 / (1 + np.exp(-2 * np.clip(x @ w, -300, 300))) - y[i, 1])
                else:
                    g = x[:, None] * (softmax(x @ w) - y[i])[None, :]
                if heft is not None:
                    g = g * heft[i]
                n += g * g
                self.z[at] = z + g - (np.sqrt(n) - root) / self.alpha * w
                self.n[at] = n
        return self.weights()


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits, from 1/20 to 20, under which y is most likely."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(1e-12, p[np.arange(len(y)), y])).mean())

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
