import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, is_anchor, positives=5, negatives=10):
    """What the contract says, every anchor against every row."""
    out = []
    usable = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for a, va, ya in (r for r in usable if is_anchor(r[0])):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(va, v)), i, y) for i, v, y in usable if i != a)
        near = [(i, -s) for s, i, y in scored if y == ya][:positives]
        for p, ps in near:
            fit = [(i, -s) for s, i, y in scored if y != ya and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, k, i, ps, s) for k, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in negatives.mined(df, F.col("id") % 10 == 0, **kw).collect())


def vectors(n, width, seed, spread=20, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 60, (centres, width))
    of = rng.integers(0, centres, n)
    label = np.where(rng.random(n) < 0.8, of, rng.integers(0, centres, n))
    return [(i, [float(x) for x in np.floor(middle[of[i]] + rng.normal(0, spread, width))], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("spread", [5, 60])
def test_same_as_every_anchor_against_every_row(spark, spread):
    rows = vectors(700, 12, spread, spread)
    want = by_hand(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert mined(spark, rows) == want
    # However the anchors are dealt into passes, and however many lists there are.
    assert mined(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), a_pass=16) == want


def test_ties_zeros_and_negative_scores(spark):
    rows = [(i, [float(i % 3 - 1), 0.0, float(i % 2)], i % 4) for i in range(200)]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    odd = [(None, [1.0], 1), (10, None, 1), (11, [None, 1.0], 2), (12, [float("nan")], 1), (13, [float("inf")], 1), (14, [1.0], None), (15, [1e300], 1)]
    good = [(20, [3.0, 1.0], 1), (21, [3.0, 1.0], 1), (22, [2.0], 2), (23, [], 2), (24, [1.0, 1.0, 7.0], 2), (30, [1.0, 2.0, 5.0], 2)]
    # A shorter vector counts as filled up; equal rows of an id as one.
    filled = [(i, v + [0.0] * (3 - len(v)), y) for i, v, y in good]
    assert mined(spark, odd + good + good) == by_hand(filled, lambda i: i % 10 == 0) != []
    assert mined(spark, odd) == []
    assert mined(spark, []) == []


def test_scores_beyond_doubles(spark):
    big = float((1 << 30) + 1)
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big * 0.5 + 0.5, 2.0], 2), (3, [math.floor(big * 0.8), 5.0], 2), (4, [math.floor(big * 0.8), 6.0], 2)]
    rows = [(i, [float(x) for x in v], y) for i, v, y in rows]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 10 == 0)


def test_extra_columns_that_clash(spark):
    rows = vectors(60, 4, 1)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(5) for c in ("id", "vector", "norm", "rank", "search", "score")})
    assert mined(spark, df) == by_hand(rows, lambda i: i % 10 == 0)


def test_a_walk_ends_early_where_clusters_are_tight():
    rows = vectors(4000, 16, 3, spread=4)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=np.int64)
    of = np.array([r[1] for r in rows])
    some = np.arange(0, len(rows), 20)
    anchors = negatives.Anchors(ids[some], labels[some], of[some])
    wanted = negatives.Wanted(np.arange(len(some)), True, np.full(len(some), negatives.LEAST), np.full(len(some), negatives.MOST), 5)
    products = negatives.walk(anchors, wanted, negatives.Found(wanted), ids, labels, of)
    assert products < 0.6 * len(some) * len(rows)


def best(scores, ids, right, most):
    """Per row of ``scores`` the ``most`` best (score, id) of the right ones."""
    return [sorted((-s, i) for s, i, r in zip(row.tolist(), ids.tolist(), ok) if r)[:most] for row, ok in zip(scores, right)]


@pytest.mark.parametrize("labels, spread, large", [(6, 4, 1), (6, 60, 1), (200, 30, 1), (1, 30, 1), (6, 30, 5000)])
def test_lists_after_each_other_equal_every_product(labels, spread, large):
    rng = np.random.default_rng(labels + spread)
    rows = vectors(5000, 12, spread, spread)
    v = np.array([r[1] for r in rows]) * large
    v[::3] = np.floor(v[::3] / 4)  # norms that differ
    v[7] = 0
    ids, y = np.arange(5000), (np.array([r[2] for r in rows]) if labels == 6 else rng.integers(0, labels, 5000))
    some = np.arange(0, 5000, 25)
    anchors = negatives.Anchors(ids[some], y[some], v[some])
    scores = (anchors.vectors @ v.T).astype(np.int64)
    same = anchors.labels[:, None] == y
    n = len(some)
    near = negatives.Wanted(np.arange(n), True, np.full(n, negatives.LEAST), np.full(n, negatives.MOST), 5)
    of = np.repeat(np.arange(n), 2)
    low, high = np.full(2 * n, -50), np.repeat(scores.max(1), 2) * np.tile([60, 90], n) // 100
    far = negatives.Wanted(of, False, low, high, 10)
    for wanted, right in ((near, same & (anchors.ids[:, None] != ids)), (far, ~same[of] & (scores[of] >= low[:, None]) & (scores[of] <= high[:, None]))):
        found = negatives.Found(wanted)
        for at in range(0, 5000, 900):
            negatives.walk(anchors, wanted, found, ids[at : at + 900], y[at : at + 900], v[at : at + 900])
        got = [[] for _ in wanted.anchor]
        for search, score, i in zip(*(a.tolist() for a in found.entries())):
            got[search].append((-score, i))
        assert got == best(scores[wanted.anchor], ids, right, wanted.most)


def test_what_is_found_is_merged_by_search(monkeypatch):
    n, most = 3000, 10
    found = negatives.Found(negatives.Wanted(np.arange(n), True, np.full(n, negatives.LEAST), np.full(n, negatives.MOST), most))
    found.add(np.repeat(np.arange(n), most), np.tile(np.arange(most), n), np.arange(n * most))
    sorted_rows, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or plain(keys))
    found.add(np.array([5, 5, 8]), np.array([99, -99, 0]), np.array([1, 2, 3]))
    assert sum(sorted_rows) <= 2 * most + 3
    assert found.bar[5] == 1 and found.bar[8] == 0 and found.bar[9] == 0
