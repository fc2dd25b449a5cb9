"""A small convolutional network over symbol windows, in numpy.

Embedding, filters of several widths, ReLU, maximum over places, softmax.
Trained with Adam; gradients of the maximum reach only the place that had it,
so a step costs little more than the forward pass.
"""

from __future__ import annotations

import numpy as np


class ConvNet:
    def __init__(self, symbols: int, classes: int, widths=(2, 3, 4), filters: int = 16, size: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.widths = widths
        self.p = {"e": rng.normal(0, 0.5, (symbols, size)), "v": rng.normal(0, 0.1, (filters * len(widths), classes)), "c": np.zeros(classes)}
        for w in widths:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * size)) ** 0.5, (w * size, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, x: np.ndarray, places: bool = False):
        embedded = self.p["e"][x]
        n, length, size = embedded.shape
        pooled, where = [], []
        for w in self.widths:
            span = length - w + 1
            out = embedded[:, :span].reshape(-1, size) @ self.p[f"w{w}"][:size]
            for k in range(1, w):
                out += embedded[:, k : k + span].reshape(-1, size) @ self.p[f"w{w}"][k * size : (k + 1) * size]
            out = out.reshape(n, span, -1)
            if places:
                best = out.argmax(1)
                where.append(best)
                pooled.append(np.maximum(0, np.take_along_axis(out, best[:, None], 1)[:, 0] + self.p[f"b{w}"]))
            else:
                pooled.append(np.maximum(0, out.max(1) + self.p[f"b{w}"]))
        return np.concatenate(pooled, 1), where

    def logits(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """Scores of each class for windows x (rows of symbols)."""
        parts = [self._pooled(x[a : a + batch])[0] @ self.p["v"] + self.p["c"] for a in range(0, len(x), batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.p["c"].size), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        size, step = self.p["e"].shape[1], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                which = order[a : a + batch]
                xb, n = x[which], len(which)
                pooled, where = self._pooled(xb, places=True)
                z = pooled @ self.p["v"] + self.p["c"]
                z = np.exp(z - z.max(1, keepdims=True))
                d = z / z.sum(1, keepdims=True)
                d[np.arange(n), y[which]] -= 1
                d /= n
                g = {"v": pooled.T @ d, "c": d.sum(0), "e": np.zeros_like(self.p["e"])}
                back = (d @ self.p["v"].T) * (pooled > 0)
                at = 0
                for w, best in zip(self.widths, where, strict=True):
                    f = best.shape[1]
                    own = back[:, at : at + f]
                    at += f
                    symbols = xb[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
                    patch = self.p["e"][symbols].reshape(n, f, w * size)
                    g[f"w{w}"] = np.einsum("nfk,nf->kf", patch, own)
                    g[f"b{w}"] = own.sum(0)
                    into = (own[:, :, None] * self.p[f"w{w}"].T[None]).reshape(n, f, w, size)
                    np.add.at(g["e"], symbols, into)
                step += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)
