"""Multinomial logistic regression on word n-grams, small enough to send to every worker."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np


def ngrams(words: list[str], longest: int) -> set[str]:
    """All runs of one to ``longest`` words, with marks for the start and the end."""
    marked = ["<", *words, ">"]
    return {" ".join(marked[i : i + n]) for n in range(1, longest + 1) for i in range(len(marked) - n + 1)}


class NgramClassifier:
    """Softmax regression with an L2 penalty, fitted by full-batch Adam from zero weights.

    N-grams in fewer than ``seen`` examples are left out. Deterministic: the same examples in the same order give the same weights.
    """

    def __init__(self, split: Callable[[str], list[str]], longest: int = 2, seen: int = 2):
        self.split, self.longest, self.seen = split, longest, seen
        self.classes: list[str] = []
        self.index: dict[str, int] = {}

    def _features(self, text: str) -> set[str]:
        return ngrams(self.split(text), self.longest)

    def fit(self, texts: Iterable[str], labels: Iterable[str], penalty: float = 1e-4, steps: int = 250, rate: float = 0.1) -> NgramClassifier:
        texts, labels = list(texts), list(labels)
        self.classes = sorted(set(labels))
        found = [self._features(t) for t in texts]
        times = Counter(f for features in found for f in features)
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in times.items() if n >= self.seen))}
        x = np.zeros((len(texts), len(self.index) + 1), np.float32)
        for row, features in enumerate(found):
            x[row, [self.index[f] for f in features if f in self.index]] = 1
        x[:, -1] = 1
        # a text weighs the same whatever its length
        x /= np.sqrt(x.sum(1, keepdims=True))
        y = np.zeros((len(texts), len(self.classes)), np.float32)
        y[np.arange(len(texts)), [self.classes.index(c) for c in labels]] = 1
        # every class weighs the same
        weight = (1 / y.sum(0))[y.argmax(1)][:, None]
        weight *= len(texts) / weight.sum()
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            z = x @ w
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - y) * weight) / len(texts) + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        return self

    def proba(self, text: str) -> np.ndarray:
        """Probability of each class of ``self.classes``; unseen n-grams count for nothing."""
        rows = [i for f in self._features(text) if (i := self.index.get(f)) is not None]
        z = (self.weights[rows].sum(0) + self.weights[-1]) / np.sqrt(len(rows) + 1)
        z = np.exp(z - z.max())
        return z / z.sum()
