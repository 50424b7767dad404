"""Gradient-boosted trees for a few classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """``cuts``: bin edges per feature; trees as arrays over heap positions, a tree per round and class."""

    cuts: list[np.ndarray]
    base: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        out = np.tile(self.base, (len(x), 1))
        row = np.arange(len(x))
        for r in range(self.feature.shape[0]):
            for c in range(self.feature.shape[1]):
                f, cut = self.feature[r, c], self.bin[r, c]
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (b[row, f[at]] > cut[at])
                out[:, c] += self.value[r, c, at]
        return out

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        z = self.log_odds(x)
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.int64)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, *, rounds: int = 40, depth: int = 4, rate: float = 0.25, least: float = 8.0) -> Boosted:
    """Softmax boosting with second-order leaf values; splits by histogram gain."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    b = binned(x, cuts)
    features, nodes = x.shape[1], 2 ** (depth + 1) - 1
    share = np.array([weight[y == c].sum() for c in range(classes)]) + 1
    base = np.log(share / share.sum())
    z = np.tile(base, (len(x), 1))
    feature, cut, value = np.zeros((rounds, classes, nodes), np.int64), np.full((rounds, classes, nodes), BINS, np.int64), np.zeros((rounds, classes, nodes))
    slot = b + np.arange(features) * BINS
    for r in range(rounds):
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(classes):
            g, h = weight * ((y == c) - p[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            at = np.zeros(len(x), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                where = ((at - first)[:, None] * features * BINS + slot).ravel()
                sums = [np.bincount(where, np.repeat(v, features), width * features * BINS).reshape(width, features, BINS).cumsum(2) for v in (g, h)]
                gl, hl = sums[0][:, :, :-1], sums[1][:, :, :-1]
                gt, ht = sums[0][:, :, -1:], sums[1][:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1).max(1) > 1e-3
                feature[r, c, first : first + width] = np.where(good, best // (BINS - 1), 0)
                cut[r, c, first : first + width] = np.where(good, best % (BINS - 1), BINS)  # no split: all go left
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[r, c, at]] > cut[r, c, at])
            leaf = rate * np.bincount(at, g, nodes) / (np.bincount(at, h, nodes) + 1)
            value[r, c] = leaf
            z[:, c] += leaf[at]
    return Boosted(cuts, base, feature, cut, value, depth)
