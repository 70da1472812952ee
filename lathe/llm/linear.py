"""Sparse logistic regression in numpy, shared by the trained operators."""

from __future__ import annotations

import numpy as np


class Rows:
    """A sparse matrix by rows: column indices, values and where each row begins."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.counts = np.array([len(i) for i, _ in rows], np.int64)
        self.cols = np.concatenate([i for i, _ in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        self.vals = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.empty(0)
        self.row = np.repeat(np.arange(len(rows)), self.counts)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        """(n,) for a vector, (n, k) for a matrix of k columns."""
        if w.ndim == 2:
            return np.stack([self.dot(w[:, k]) for k in range(w.shape[1])], axis=1)
        return np.bincount(self.row, self.vals * w[self.cols], self.n).astype(np.float64)

    def back(self, g: np.ndarray) -> np.ndarray:
        if g.ndim == 2:
            return np.stack([self.back(g[:, k]) for k in range(g.shape[1])], axis=1)
        return np.bincount(self.cols, self.vals * g[self.row], self.width).astype(np.float64)

    def pick(self, keep: np.ndarray) -> Rows:
        """The rows that a boolean array keeps."""
        out, inside = object.__new__(Rows), keep[self.row]
        out.counts, out.cols, out.vals = self.counts[keep], self.cols[inside], self.vals[inside]
        out.n, out.width = int(keep.sum()), self.width
        out.row = np.repeat(np.arange(out.n), out.counts)
        return out


    def among(self, keep: np.ndarray) -> Rows:
        """The columns that a boolean array keeps, numbered anew."""
        out, inside = object.__new__(Rows), keep[self.cols]
        out.cols, out.vals, out.row = (np.cumsum(keep) - 1)[self.cols[inside]], self.vals[inside], self.row[inside]
        out.n, out.width = self.n, int(keep.sum())
        out.counts = np.bincount(out.row, minlength=out.n)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_binary(x: Rows, extra: np.ndarray, y: np.ndarray, l1: float = 1e-4, l2: float = 1e-4, rounds: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of x, weights of the dense columns extra, bias: elastic net by accelerated proximal steps.

    The step comes from the largest squared row norm, an upper bound of the curvature times four.
    """
    n = max(1, x.n)
    norms = np.bincount(x.row, x.vals**2, x.n) + (extra**2).sum(axis=1) + 1
    # A power iteration finds the curvature; row norms alone give far shorter steps.
    v = np.ones(x.width)
    for _ in range(8):
        v = x.back(x.dot(v))
        scale = np.linalg.norm(v) or 1.0
        v = v / scale
    step = 1 / (0.25 * (1.2 * scale / n + float(((extra**2).sum() / n) + 1)) + l2) if x.n else 1 / max(1.0, float(norms.max(initial=1)))
    w, e, b = np.zeros(x.width), np.zeros(extra.shape[1]), 0.0
    pw, pe, pb, t = w, e, b, 1.0
    for _ in range(rounds):
        g = (sigmoid(x.dot(pw) + extra @ pe + pb) - y) / n
        nw = pw - step * (x.back(g) + l2 * pw)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        ne, nb = pe - step * (extra.T @ g + l2 * pe), pb - step * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        m = (t - 1) / t2
        pw, pe, pb = nw + m * (nw - w), ne + m * (ne - e), nb + m * (nb - b)
        w, e, b, t = nw, ne, nb, t2
    return w, e, float(b)


def fit_classes(x: Rows, y: np.ndarray, k: int, l2: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression: weights (width, k) and biases (k,), by accelerated gradient steps."""
    want = np.eye(k)[y]
    v = np.ones(x.width)
    scale = 1.0
    for _ in range(8):
        v = x.back(x.dot(v))
        scale = np.linalg.norm(v) or 1.0
        v = v / scale
    step = 1 / (0.5 * (1.2 * scale / max(1, x.n) + 1) + l2)
    w, b = np.zeros((x.width, k)), np.zeros(k)
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        g = (softmax(x.dot(pw) + pb) - want) / max(1, x.n)
        nw, nb = pw - step * (x.back(g) + l2 * pw), pb - step * g.sum(axis=0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
