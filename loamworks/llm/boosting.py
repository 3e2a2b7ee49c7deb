"""Gradient-boosted trees for binary labels on small tables, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from loamworks.llm.reading import isotonic


@dataclass(frozen=True)
class Boosted:
    """Trees of fixed depth as arrays: feature and threshold of each inner node, values of the leaves."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def _fit(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int) -> Boosted:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    score = np.full(len(y), base)
    inner, outer = 2**depth - 1, 2**depth
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, c, v = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(outer)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            # all nodes of a level at once
            width, low = 2**level, 2**level - 1
            local = node - low
            sums = np.bincount(local, g, width), np.bincount(local, h, width)
            total = sums[0] ** 2 / (sums[1] + 1)
            best = np.full(width, 1e-6)
            for k, e in enumerate(edges):
                m = len(e) + 1
                if m == 1:
                    continue
                at = local * m + code[:, k]
                gs, hs, ns = (np.cumsum(np.bincount(at, w, width * m).reshape(width, m), axis=1) for w in (g, h, None))
                gain = gs[:, :-1] ** 2 / (hs[:, :-1] + 1) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + 1) - total[:, None]
                gain[(ns[:, :-1] < 5) | (ns[:, -1:] - ns[:, :-1] < 5)] = 0
                j = gain.argmax(axis=1)
                top = gain[np.arange(width), j]
                more = np.flatnonzero(top > best)
                best[more], f[low + more], c[low + more] = top[more], k, e[j[more]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, outer) / (np.bincount(leaf, h, outer) + 1)
        score += v[leaf]
        features.append(f)
        cuts.append(c)
        leaves.append(v)
    return Boosted(base, np.array(features), np.array(cuts), np.array(leaves), (np.array([0.0]), np.array([0.5])))


def fit_held(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 16) -> tuple[Boosted, np.ndarray]:
    """Trees on all rows, with probabilities by isotonic regression of scores held out in two folds; and each row's held-out probability."""
    order = np.random.default_rng(0).permutation(len(y))
    a, b = np.asarray(x, float)[order], np.asarray(y, float)[order]
    held = np.empty(len(y))
    for k in (0, 1):
        part = np.arange(len(y)) % 2 == k
        held[part] = _fit(a[~part], b[~part], trees, depth, rate, bins).raw(a[part])
    model = _fit(a, b, trees, depth, rate, bins)
    knots = isotonic(held, b)
    out = np.empty(len(y))
    out[order] = np.interp(held, *knots)
    return Boosted(model.base, model.features, model.cuts, model.leaves, knots), out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 16) -> Boosted:
    return fit_held(x, y, trees, depth, rate, bins)[0]
