"""A small convolutional text classifier in numpy: embeddings, filters of several widths, max pooling, softmax."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class TextCNN:
    """Symbols are 0 (padding) to symbols - 1; a sequence's features are each filter's largest response in it, cut at 0."""

    emb: np.ndarray
    filters: dict[int, tuple[np.ndarray, np.ndarray]]  # width: (width x embedding x filters, biases)
    out: np.ndarray
    bias: np.ndarray
    classes: list = field(default_factory=list)

    @classmethod
    def new(cls, symbols: int, classes: list, size: int, widths: tuple[int, ...], filters: int, seed: int = 7, spread: float = 0.3) -> TextCNN:
        draw = np.random.default_rng(seed)
        emb = draw.normal(0, spread, (symbols, size)).astype(np.float32)
        emb[0] = 0
        made = {w: (draw.normal(0, (w * size) ** -0.5, (w, size, filters)).astype(np.float32), np.zeros(filters, np.float32)) for w in widths}
        return cls(emb, made, draw.normal(0, 0.3, (filters * len(widths), len(classes))).astype(np.float32), np.zeros(len(classes), np.float32), classes)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *(x for w in self.filters.values() for x in w), self.out, self.bias]

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.out + self.bias

    def embedded(self, seq: np.ndarray) -> np.ndarray:
        """Embeddings of symbols, or their sums over a last axis that holds the symbols of one place."""
        return sum(self.emb[seq[..., k]] for k in range(seq.shape[-1])) if seq.ndim == 3 else self.emb[seq]

    def _forward(self, seq: np.ndarray):
        """Features of rows of symbols, and where each filter's largest response begins."""
        x, found, at = self.embedded(seq), [], []
        for w, (f, b) in self.filters.items():
            n = seq.shape[1] - w + 1
            y = sum(x[:, j : j + n] @ f[j] for j in range(w)) + b
            at.append(y.argmax(axis=1))
            found.append(np.take_along_axis(y, at[-1][:, None], 1)[:, 0])
        h = np.concatenate(found, axis=1)
        return np.maximum(h, 0), at

    def fit(self, seqs: np.ndarray | list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 0.0, seed: int = 11, lazy: bool = False) -> TextCNN:
        """Adam on the weighted cross-entropy. labels: numbers of classes. Sequences may differ in length; they're taken whole.

        lazy: a step leaves embeddings (and their moments) alone that it has no gradient for, so it costs what its batch does.
        """
        weights = np.ones(len(labels), np.float32) if weights is None else weights.astype(np.float32)
        draw, step, total = np.random.default_rng(seed), 0, batch * float(weights.mean())
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        for epoch in range(epochs):
            for rows in batches(np.array([len(s) for s in seqs]), batch, draw):
                (at, g), grads = self._sparse(padded([seqs[i] for i in rows]), labels[rows], weights[rows], total)
                now, step = rate * (1 - 0.9 * epoch / max(1, epochs)), step + 1
                if not lazy:
                    at, g = slice(None), self._dense(at, g)
                for p, g, at, (m, v) in zip(self.params(), [g, *grads], [at] + [slice(None)] * len(grads), moments):
                    if decay and p is not self.bias:
                        g = g + decay * p[at]
                    m[at] = some = 0.9 * m[at] + 0.1 * g
                    v[at] = square = 0.999 * v[at] + 0.001 * g * g
                    p[at] -= now * (some / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-7)
                self.emb[0] = 0
        return self

    def _gradients(self, seq, labels, weights, total: float | None = None) -> list[np.ndarray]:
        (at, g), grads = self._sparse(seq, labels, weights, total)
        return [self._dense(at, g), *grads]

    def _dense(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        demb = np.zeros_like(self.emb)
        demb[at] = g
        return demb

    def _sparse(self, seq, labels, weights, total: float | None = None) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
        """The symbols that have a gradient and theirs, and those of the other parameters."""
        h, at = self._forward(seq)
        z = self.logits(h)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        dz = p * (weights / (total or weights.sum()))[:, None]
        dh = (dz @ self.out.T) * (h > 0)
        grads, names, backs, first = [], [], [], 0
        rows = np.arange(len(labels))[:, None]
        for (w, (f, _)), a in zip(self.filters.items(), at):
            d = dh[:, first : first + f.shape[2]]
            first += f.shape[2]
            df = np.empty_like(f)
            for j in range(w):
                sym = seq[rows, a + j]  # batch x filters, then the symbols of a place
                df[j] = np.einsum("bf,bfe->ef", d, self.embedded(sym))
                back = (d[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1])
                for k in range(sym[0, 0].size):
                    names.append(sym.reshape(len(back), -1)[:, k])
                    backs.append(back)
            grads += [df, d.sum(axis=0)]
        found, to = np.unique(np.concatenate(names), return_inverse=True)
        demb = np.zeros((len(found), self.emb.shape[1]), self.emb.dtype)
        np.add.at(demb, to, np.concatenate(backs))
        return (found, demb), [*grads, h.T @ dz, dz.sum(axis=0)]


def batches(size: np.ndarray, most: int, draw: np.random.Generator, places: int = 1 << 17) -> list[np.ndarray]:
    """All rows, in batches of like sizes of at most `most` rows and about `places` places; a longer row is one alone."""
    order = np.argsort(size * (1 + 0.3 * draw.random(len(size))))
    found, first = [], 0
    for i in range(1, len(order) + 1):
        if i == len(order) or i - first == most or (i - first + 1) * size[order[first : i + 1]].max() > places:
            found.append(order[first:i])
            first = i
    draw.shuffle(found)
    return found


def padded(seqs: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(seqs), max(map(len, seqs)), *seqs[0].shape[1:]), np.int32)
    for row, s in zip(out, seqs):
        row[: len(s)] = s
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)
