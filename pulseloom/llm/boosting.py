"""Gradient boosted trees for a few thousand labelled rows: fitted in numpy, applied inside tasks."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Logistic boosting of small regression trees over binned features, with a calibrated output.

    The sample is cut by row number: three of four rows fit the trees, the fourth fits the calibration.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.2, leaf: float = 5.0):
        held = np.arange(len(y)) % 4 == 3
        fit_x, fit_y = x[~held], y[~held].astype(float)
        self.cuts = [np.unique(np.quantile(fit_x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(fit_x)
        mean = np.clip(fit_y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees, self.rate = np.log(mean / (1 - mean)), [], rate
        margin = np.full(len(fit_y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, fit_y - p, p * (1 - p), depth, leaf)
            self.trees.append(tree)
            margin += rate * self._apply(tree, binned)
        self.steps = self._calibrate(self.margin(x[held]), y[held].astype(float))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], 1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, leaf: float):
        value = g.sum() / (h.sum() + 1.0)
        if depth == 0 or len(g) < 2 * leaf:
            return value
        best = (1e-6, None)
        for f in range(b.shape[1]):
            gs = np.bincount(b[:, f], g, BINS + 1).cumsum()[:-1]
            hs = np.bincount(b[:, f], h, BINS + 1).cumsum()[:-1]
            n = np.bincount(b[:, f], minlength=BINS + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(n < leaf) | (len(g) - n < leaf)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            return value
        f, k = best[1]
        low = b[:, f] <= k
        return f, k, self._grow(b[low], g[low], h[low], depth - 1, leaf), self._grow(b[~low], g[~low], h[~low], depth - 1, leaf)

    def _apply(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, k, low, high = tree
        return np.where(b[:, f] <= k, self._apply(low, b), self._apply(high, b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + self.rate * sum((self._apply(t, b) for t in self.trees), np.zeros(len(x)))

    def _calibrate(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Isotonic steps: margins and the share of positives from each on, neighbours pooled until they increase."""
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []
        for m, v in zip(margin[order], y[order]):
            blocks.append([m, v, 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                _, s, n = blocks.pop()
                blocks[-1][1] += s
                blocks[-1][2] += n
        return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])

    def probability(self, x: np.ndarray) -> np.ndarray:
        at, share = self.steps
        if not len(x) or not len(at):
            return np.zeros(len(x))
        return share[np.clip(np.searchsorted(at, self.margin(x), side="right") - 1, 0, len(share) - 1)]
