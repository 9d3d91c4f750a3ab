"""Trees of many series at a time against a plain recursion on one."""

import numpy as np
import pytest

from tallyworks.functions import trees


def plain(x, y, w, depth):
    """Nested (feature, threshold, left, right) or a value: every split tried, the first best one taken."""
    mean = (w * y).sum() / w.sum()
    if depth == 0:
        return mean
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[w > 0, f])
        for low, high in zip(values[:-1], values[1:]):
            left = x[:, f] <= low
            a, b = w * left, w * ~left
            gain = (a * y).sum() ** 2 / a.sum() + (b * y).sum() ** 2 / b.sum() - (w * y).sum() ** 2 / w.sum()
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (low + high) / 2, left)
    if best is None or best[0] <= 1e-9:
        return mean
    _, f, threshold, left = best
    return f, threshold, plain(x, y, w * left, depth - 1), plain(x, y, w * ~left, depth - 1)


def answer(tree, row):
    while isinstance(tree, tuple):
        f, threshold, left, right = tree
        tree = left if row[f] <= threshold else right
    return tree


def data(seed, n, features=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 1)
    return x, np.round(3 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n), 3)


def test_trees_as_plain_recursion_grows_them():
    series = [data(i, 30) for i in range(3)]
    x, y = np.stack([s[0] for s in series]), np.stack([s[1] for s in series])
    w = np.random.default_rng(9).integers(0, 3, y.shape).astype(float)
    got = trees.grow(trees.Bins.of(x), np.arange(3), y, w, 4)
    new = np.random.default_rng(1).normal(size=(3, 50, 4))
    for at in (x, new):
        said = got.predict(at)
        for s in range(3):
            want = plain(x[s], y[s], w[s], 4)
            assert said[s] == pytest.approx([answer(want, row) for row in at[s]])


def test_boosted_series_do_not_touch_each_other():
    sizes = (40, 25, 1)
    series = [data(i + 5, n) for i, n in enumerate(sizes)]
    x, y, w = np.zeros((3, 40, 4)), np.zeros((3, 40)), np.zeros((3, 40))
    for s, (xs, ys) in enumerate(series):
        x[s, : len(ys)], y[s, : len(ys)], w[s, : len(ys)] = xs, ys, 1
    got = trees.boosted(x, y, w, 10, 3).predict(x)
    for s, (xs, ys) in enumerate(series):
        said = np.full(len(ys), ys.mean())
        for _ in range(10):
            tree = plain(xs, ys - said, np.ones(len(ys)), 3)
            said = said + 0.1 * np.array([answer(tree, row) for row in xs])
        assert got[s, : len(ys)] == pytest.approx(said)


def test_a_forest_is_the_trees_of_its_drawings():
    x, y = data(3, 35)
    got = trees.forest(x, y, 6, 5, 42).predict(x[None])
    drawn = np.random.default_rng(42).integers(0, 35, (6, 35))
    for t in range(6):
        want = plain(x, y, np.bincount(drawn[t], minlength=35).astype(float), 5)
        assert got[t] == pytest.approx([answer(want, row) for row in x])


def test_constant_targets_and_features():
    x = np.ones((2, 5, 2))
    x[1, :, 0] = np.arange(5)
    got = trees.grow(trees.Bins.of(x), np.arange(2), np.array([[1.0, 2, 3, 4, 5], [7.0] * 5]), np.ones((2, 5)), 3)
    assert (got.feature == -1).all() and got.predict(x)[0] == pytest.approx([3.0] * 5) and got.predict(x)[1] == pytest.approx([7.0] * 5)
