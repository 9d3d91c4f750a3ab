"""Regression trees of short series, a level of many trees at a time (NumPy, runs inside Spark tasks).

Features are binned by their distinct values, so the histograms of a level hold every possible split. The rows of all trees
that are being grown are counted together; a tree's node is one part of the key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Sums of squares closer than this, relative to the target's, count as equal.
LEAST_GAIN = 1e-12


@dataclass
class Bins:
    """Features of several series: the place of each value among the distinct ones, and those."""

    ranks: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Bins:
        """``x`` is (series, row, feature)."""
        order = np.sort(x, axis=1)
        new = np.ones(order.shape, dtype=bool)
        new[:, 1:] = order[:, 1:] != order[:, :-1]
        place = np.cumsum(new, axis=1) - 1
        values = np.full(x.shape, np.inf)
        s, _, f = np.indices(x.shape)
        values[s, place, f] = order
        ranks = np.empty(x.shape, dtype=np.int64)
        at = np.argsort(x, axis=1, kind="stable")
        np.put_along_axis(ranks, at, place, axis=1)
        return cls(ranks, values)


@dataclass
class Trees:
    """Binary trees in heap order (children of node i are 2i + 1 and 2i + 2); feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(tree, row) for ``x`` of (tree or 1, row, feature)."""
        tree = np.arange(len(self.feature))[:, None]
        x = np.broadcast_to(x, (len(self.feature), *x.shape[1:]))
        node = np.zeros(x.shape[:2], dtype=np.int64)
        while True:
            feature = self.feature[tree, node]
            inner = feature >= 0
            if not inner.any():
                return self.value[tree, node]
            asked = np.take_along_axis(x, np.maximum(feature, 0)[:, :, None], axis=2)[:, :, 0]
            after = 2 * node + 1 + (asked > self.threshold[tree, node])
            node = np.where(inner, after, node)


def grow(bins: Bins, series: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int) -> Trees:
    """A tree for every row of ``target`` and ``weight`` (tree, row) on the features of its series.

    A node is split where the weighted squares fall most, the first feature and the lowest threshold of equals; the
    threshold lies midway between the values on both sides. Leaves hold weighted means.
    """
    t, n = target.shape
    size, width, features = (1 << (depth + 1)) - 1, bins.values.shape[1], bins.ranks.shape[2]
    trees = Trees(np.full((t, size), -1, dtype=np.int8), np.zeros((t, size)), np.zeros((t, size)))
    tree, row = np.nonzero(weight > 0)
    y, w = target[tree, row], weight[tree, row]
    ranks = bins.ranks[series[tree], row]
    node = np.zeros(len(tree), dtype=np.int64)
    floor = LEAST_GAIN * (np.bincount(tree, w * y * y, minlength=t) + 1e-300)
    for level in range(depth + 1):
        if not len(tree):
            break
        keys, at = np.unique(tree * size + node, return_inverse=True)
        k = len(keys)
        total, mass = np.bincount(at, w * y, minlength=k), np.bincount(at, w, minlength=k)
        of, here = keys // size, keys % size
        trees.value[of, here] = total / mass
        if level == depth:
            break
        best, feature, place, threshold = np.full(k, -np.inf), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k)
        for f in range(features):
            cell = at * width + ranks[:, f]
            masses = np.cumsum(np.bincount(cell, w, minlength=k * width).reshape(k, width), axis=1)
            sums = np.cumsum(np.bincount(cell, w * y, minlength=k * width).reshape(k, width), axis=1)
            right = mass[:, None] - masses
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sums**2 / masses + (total[:, None] - sums) ** 2 / right - (total**2 / mass)[:, None]
            gain[(masses <= 0) | (right <= 1e-9 * mass[:, None])] = -np.inf
            cut = np.argmax(gain, axis=1)
            found = gain[np.arange(k), cut]
            won = found > best + floor[of]
            # The next value that the node has.
            after = np.argmax(masses > masses[np.arange(k), cut][:, None], axis=1)
            values = bins.values[series[of], :, f]
            with np.errstate(invalid="ignore"):
                between = (values[np.arange(k), cut] + values[np.arange(k), after]) / 2
            best[won], feature[won], place[won], threshold[won] = found[won], f, cut[won], between[won]
        split = best > floor[of]
        trees.feature[of[split], here[split]] = feature[split]
        trees.threshold[of[split], here[split]] = threshold[split]
        stays = split[at]
        at, tree, node, y, w, ranks = at[stays], tree[stays], node[stays], y[stays], w[stays], ranks[stays]
        node = 2 * node + 1 + (ranks[np.arange(len(at)), feature[at]] > place[at])
    return trees


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> Trees:
    """Trees on as many rows drawn with replacement, for one series: ``x`` (row, feature), ``y`` (row)."""
    drawn = np.random.default_rng(seed).integers(0, len(y), (trees, len(y)))
    weight = np.zeros((trees, len(y)))
    np.add.at(weight, (np.arange(trees)[:, None], drawn), 1.0)
    return grow(Bins.of(x[None]), np.zeros(trees, dtype=np.int64), np.broadcast_to(y, weight.shape), weight, depth)


@dataclass
class Boosted:
    """A mean and trees on what was left, for several series; ``rounds`` has a tree per series each."""

    start: np.ndarray
    rate: float
    rounds: list[Trees]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(series, row) for ``x`` (series, row, feature)."""
        out = np.repeat(self.start[:, None], x.shape[1], axis=1)
        for trees in self.rounds:
            out = out + self.rate * trees.predict(x)
        return out


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float = 0.1) -> Boosted:
    """Boosted trees of several series at once: ``x`` (series, row, feature), ``y`` and 0 or 1 in ``weight`` (series, row)."""
    bins, series = Bins.of(x), np.arange(len(y))
    start = (weight * y).sum(1) / np.maximum(weight.sum(1), 1)
    said, made = np.repeat(start[:, None], y.shape[1], axis=1), []
    for _ in range(rounds):
        trees = grow(bins, series, y - said, weight, depth)
        said = said + rate * trees.predict(x)
        made.append(trees)
    return Boosted(start, rate, made)
