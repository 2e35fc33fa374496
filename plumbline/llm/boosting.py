"""Gradient-boosted trees of depth two over small numeric features, fitted in numpy and scored as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Leaves in the order low-low, low-high, high-low, high-high; a value at or below a cut goes low."""

    feature: tuple[int, int, int]
    cut: tuple[float, float, float]
    leaf: tuple[float, float, float, float]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[int, float, float]:
    """Best feature and cut by second-order gain; gain 0 where nothing separates."""
    best = (0, 0.0, 0.0)
    base = g.sum() ** 2 / (h.sum() + shrink) if len(g) else 0.0
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gain = g[low].sum() ** 2 / (h[low].sum() + shrink) + g[~low].sum() ** 2 / (h[~low].sum() + shrink) - base
            if gain > best[2] + 1e-12:
                best = (f, float(cut), float(gain))
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3, shrink: float = 1.0) -> tuple[float, list[Tree]]:
    """Logistic loss. Rows that agree in all features and in the label are fitted as one row with a weight."""
    both, weight = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y = both[:, :-1], both[:, -1]
    mean = np.clip((weight * y).sum() / max(1, weight.sum()), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        f0, c0, gain = _split(x, g, h, shrink)
        if gain <= 0:
            break
        high = x[:, f0] > c0
        parts = [_split(x[side], g[side], h[side], shrink) for side in (~high, high)]
        leaf = []
        for side, (f, c, _) in zip((~high, high), parts):
            for up in (False, True):
                here = side & ((x[:, f] > c) == up)
                leaf.append(float(-rate * g[here].sum() / (h[here].sum() + shrink)))
        tree = Tree((f0, parts[0][0], parts[1][0]), (c0, parts[0][1], parts[1][1]), tuple(leaf))
        trees.append(tree)
        score += value(tree, x)
    return start, trees


def value(tree: Tree, x: np.ndarray) -> np.ndarray:
    top = (x[:, tree.feature[0]] > tree.cut[0]).astype(int)
    low, high = ((x[:, tree.feature[k]] > tree.cut[k]).astype(int) for k in (1, 2))
    return np.asarray(tree.leaf)[2 * top + np.where(top == 1, high, low)]


def scores(start: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return start + sum((value(t, x) for t in trees), np.zeros(len(x)))


def expression(start: float, trees: list[Tree], features: list[Column]) -> Column:
    """The score as a column, for code generation in the JVM."""
    total = F.lit(start)
    for t in trees:
        a, b, c = (features[f] > F.lit(cut) for f, cut in zip(t.feature, t.cut))
        low = F.when(b, F.lit(t.leaf[1])).otherwise(F.lit(t.leaf[0]))
        high = F.when(c, F.lit(t.leaf[3])).otherwise(F.lit(t.leaf[2]))
        total = total + F.when(a, high).otherwise(low)
    return total


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make a sigmoid of the scores a probability; smoothed targets, Newton steps."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([1.0, 0.0])
    a = np.column_stack([score, np.ones(len(score))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
