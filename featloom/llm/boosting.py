"""Gradient boosting of small regression trees for a yes-or-no label, and its calibration, in numpy.

Features are cut into bins at their quantiles. A tree is complete: each level picks for every node the split
with the greatest gain in second-order logistic loss. A model is a few arrays, whatever the number of rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


class Tree(NamedTuple):
    feature: np.ndarray    # of the inner nodes, level by level
    threshold: np.ndarray  # greater values go right
    leaf: np.ndarray


class Model(NamedTuple):
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(t.feature) and node[:1].size and node[0] < len(t.feature):
                node = 2 * node + 1 + (x[row, t.feature[node]] > t.threshold[node])
            out += t.leaf[node - len(t.feature)]
        return out


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds of every feature."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, step: float = 0.2, penalty: float = 1.0,
        least: float = 2.0) -> Model:
    """Trees for rows `x` and labels `y` (0 or 1); `least` is the least weight of a side of a split."""
    cuts = _cuts(x)
    codes = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    features = x.shape[1]
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, threshold = [], []
        for level in range(depth):
            nodes = 1 << level
            g, w = np.zeros((nodes, features, BINS + 1)), np.zeros((nodes, features, BINS + 1))
            for f in range(features):
                at = node * (BINS + 1) + codes[:, f]
                g[:, f] = np.bincount(at, gradient, nodes * (BINS + 1)).reshape(nodes, -1)
                w[:, f] = np.bincount(at, weight, nodes * (BINS + 1)).reshape(nodes, -1)
            left_g, left_w = g.cumsum(axis=2)[:, :, :-1], w.cumsum(axis=2)[:, :, :-1]
            right_g, right_w = g.sum(axis=2, keepdims=True) - left_g, w.sum(axis=2, keepdims=True) - left_w
            gain = left_g ** 2 / (left_w + penalty) + right_g ** 2 / (right_w + penalty)
            usable = (left_w >= least) & (right_w >= least)
            for f in range(features):
                usable[:, f, len(cuts[f]):] = False
            best = np.where(usable, gain, -1.0).reshape(nodes, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            split = usable.reshape(nodes, -1)[np.arange(nodes), best]
            feature.append(np.where(split, f, 0))
            # a node without a usable split sends all rows left
            threshold.append(np.array([cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, split)]))
            node = 2 * node + (x[np.arange(len(x)), feature[-1][node]] > threshold[-1][node])
        leaves = 1 << depth
        leaf = step * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + penalty)
        trees.append(Tree(np.concatenate(feature), np.concatenate(threshold), leaf))
        margin = margin + leaf[node]
    return Model(base, trees)


class Calibration(NamedTuple):
    """Probability of a margin: 1 / (1 + exp(-(slope * margin + offset)))."""
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> Calibration:
    """Logistic regression of held-out labels on margins (Newton's method, labels drawn in a little from 0 and 1)."""
    yes, no = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, v = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -500, 500)))
        w = p * (1 - p) + 1e-9
        move = np.linalg.solve((x * w[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        v = v + move
        if np.abs(move).max() < 1e-9:
            break
    return Calibration(float(v[0]), float(v[1]))


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on the share of true labels reaches `precision`; above 1 if there is none."""
    order = np.argsort(-probability, kind="stable")
    p, right = probability[order], np.cumsum(y[order])
    last = np.append(p[:-1] != p[1:], True) if len(p) else np.zeros(0, bool)  # equal probabilities go together
    good = np.nonzero(last & (right >= precision * np.arange(1, len(p) + 1)))[0]
    return float(p[good[-1]]) if len(good) else 1.5
