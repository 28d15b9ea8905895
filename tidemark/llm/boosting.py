"""Small gradient-boosted trees with a logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: node i has children 2i + 1 and 2i + 2; leaves follow the inner nodes."""

    depth: int
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Newton boosting over quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # code > k means x > cuts[k]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model, inner = Trees(depth, float(np.log(share / (1 - share)))), 2**depth - 1
    margin = np.full(n, model.start)
    offset = np.arange(width) * bins
    for _ in range(rounds):
        p = sigmoid(margin)
        gradient, curvature = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * width * bins + offset + code).ravel()
            g = np.bincount(slot, np.repeat(gradient, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(curvature, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, curvature, 2**depth) + ridge)
        margin += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model


def fit_isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on z by pooling adjacent violators; equal z are pooled first.  Knots and levels."""
    knots, inverse = np.unique(z, return_inverse=True)
    blocks: list[list[float]] = []
    for mean, weight in zip(np.bincount(inverse, y) / np.bincount(inverse), np.bincount(inverse)):
        blocks.append([float(mean), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + k]
    return knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])
