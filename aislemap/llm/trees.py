"""Gradient-boosted trees on a bounded sample, as arrays that workers can read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Values up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            split = self.feature[at]
            open_ = np.flatnonzero(split >= 0)
            if not len(open_):
                return self.value[at]
            here = at[open_]
            low = x[open_, split[open_]] <= self.threshold[here]
            at[open_] = np.where(low, self.left[here], self.right[here])

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conditions (feature, is above, threshold) on the way to every node but the root."""
        out, todo = [], [(0, ())]
        while todo:
            at, path = todo.pop()
            if path:
                out.append(path)
            if self.feature[at] >= 0:
                f, t = int(self.feature[at]), float(self.threshold[at])
                todo += [(int(self.left[at]), (*path, (f, False, t))), (int(self.right[at]), (*path, (f, True, t)))]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds halfway between neighbouring values, at most ``bins - 1`` per feature."""
    out = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins), method="nearest"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, smooth: float) -> Tree:
    feature, threshold, left, right, value = [-1], [0.0], [-1], [-1], [-rate * g.sum() / (h.sum() + smooth)]
    at, level = np.zeros(len(g), np.int64), [0]
    for _ in range(depth):
        place = np.full(len(feature), -1)
        place[level] = np.arange(len(level))
        where = place[at]
        live = where >= 0
        best = np.full(len(level), 1e-6)
        choice: list = [None] * len(level)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            width = len(cut) + 1
            slot = where[live] * width + codes[live, f]
            sums = [np.bincount(slot, w[live], len(level) * width).reshape(-1, width).cumsum(axis=1) for w in (g, h)]
            gl, hl = sums[0][:, :-1], sums[1][:, :-1]
            gt, ht = sums[0][:, -1:], sums[1][:, -1:]
            gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            top = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                best[i], choice[i] = gain[i, top[i]], (f, int(top[i]))
        following = []
        for i, node in enumerate(level):
            if choice[i] is None:
                continue
            f, code = choice[i]
            rows = np.flatnonzero(at == node)
            low = codes[rows, f] <= code
            feature[node], threshold[node] = f, float(cuts[f][code])
            for side, part in ((left, rows[low]), (right, rows[~low])):
                side[node] = len(feature)
                at[part] = len(feature)
                following.append(len(feature))
                feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1)
                value.append(-rate * g[part].sum() / (h[part].sum() + smooth))
        level = following
        if not level:
            break
    return Tree(*(np.array(a) for a in (feature, threshold, left, right, value)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, smooth: float = 1.0, weight: np.ndarray | None = None) -> tuple[float, list[Tree]]:
    """Start value and trees of a logistic model; without both classes there are no trees."""
    weight = np.ones(len(y)) if weight is None else weight
    share = (float((y * weight).sum()) + 1) / (float(weight.sum()) + 2)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return start, []
    cuts = _cuts(x, bins)
    codes = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
    score, grown = np.full(len(y), start), []
    for _ in range(trees):
        p = sigmoid(score)
        tree = _grow(codes, cuts, (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight, depth, rate, smooth)
        grown.append(tree)
        score += tree.predict(x)
    return start, grown
