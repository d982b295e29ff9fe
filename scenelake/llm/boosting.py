"""Gradient-boosted regression trees for binary labels in numpy, with isotonic calibration.

Fitting happens on the driver over a bounded sample of rows; a fitted model is a few hundred numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right, value) arrays; node 0 is the root, feature -1 a leaf; left: x <= threshold."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10) -> Boosted:
    """Logistic boosting with Newton leaves over quantile bins. x: (n, features); y: 0 or 1."""
    y = y.astype(float)
    p0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p0 / (1 - p0))), [])
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # midpoints, so that a cut lies between values and not on one
    for j, c in enumerate(cuts):
        values = np.unique(x[:, j])
        above = values[np.minimum(np.searchsorted(values, c, side="right"), len(values) - 1)]
        cuts[j] = np.unique((c + above) / 2)
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        tree = _grow(codes, cuts, grad, hess, depth, rate, least)
        model.trees.append(tree)
        score += Boosted(0.0, [tree]).raw(x)
    return model


def _grow(codes, cuts, grad, hess, depth, rate, least):
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        k = len(feature)
        feature.append(-1), cut.append(0.0), left.append(0), right.append(0)
        g, h = grad[rows].sum(), hess[rows].sum()
        value.append(rate * g / (h + 1.0))
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if len(c) == 0:
                    continue
                n_b = len(c) + 1
                gs = np.cumsum(np.bincount(codes[rows, j], grad[rows], n_b))[:-1]
                hs = np.cumsum(np.bincount(codes[rows, j], hess[rows], n_b))[:-1]
                ns = np.cumsum(np.bincount(codes[rows, j], minlength=n_b))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is not None:
            j, b = best[1], best[2]
            go = codes[rows, j] <= b
            feature[k], cut[k] = j, float(cuts[j][b])
            left[k] = node(rows[go], level + 1)
            right[k] = node(rows[~go], level + 1)
        return k

    node(np.arange(len(grad)), 0)
    return (np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (x, p) knots, p rising; apply with np.interp."""
    if len(raw) == 0:
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(raw, kind="stable")
    xs, blocks = raw[order], []  # blocks: sum of y, count, first and last x
    for x, v in zip(xs, y[order].astype(float), strict=True):
        blocks.append([v, 1.0, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, b = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = b
    kx, kp = [], []
    for s, n, a, b in blocks:
        p = (s + 0.5 * y.mean()) / (n + 0.5)
        kx += [a] if a == b else [a, b]
        kp += [p] if a == b else [p, p]
    return np.array(kx), np.maximum.accumulate(np.array(kp))
