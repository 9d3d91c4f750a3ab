"""Isolation forest: trees grown in parallel from bounded samples, rows scored in place."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tallyworks.functions.columns import hash_unit
from tallyworks.functions.lineage import materialise
from tallyworks.functions.quantiles import exact_quantiles

SAMPLES_PER_TREE = 256
TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict[str, list]:
    """Random axis-parallel splits until a point is alone, equal to its company, or deep enough."""
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def grow(rows: np.ndarray, depth: int) -> int:
        node = len(tree["feature"])
        for name, empty in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("path", 0.0)):
            tree[name].append(empty)
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= max_depth or splittable.size == 0:
            tree["path"][node] = depth + mean_path(len(rows))
            return node
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = rows[:, f] <= cut
        tree["feature"][node], tree["threshold"][node] = f, cut
        tree["left"][node] = grow(rows[goes_left], depth + 1)
        tree["right"][node] = grow(rows[~goes_left], depth + 1)
        return node

    grow(points, 0)
    return tree


def path_lengths(points: np.ndarray, tree: dict[str, np.ndarray], max_depth: int) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    each = np.arange(len(points))
    for _ in range(max_depth):
        feature = tree["feature"][node]
        inner = feature >= 0
        if not inner.any():
            break
        left = points[each, np.maximum(feature, 0)] <= tree["threshold"][node]
        node = np.where(inner, np.where(left, tree["left"][node], tree["right"][node]), node)
    return tree["path"][node]


def sample_for_trees(df: DataFrame, columns: Sequence[str], trees: int, seed: int, samples_per_tree: int = SAMPLES_PER_TREE) -> DataFrame:
    """(tree, columns): ``samples_per_tree`` rows for each tree, or all rows of a smaller frame.

    Every row can reach every tree. Equal points are counted together; a point that stands c times
    sends a tree floor(c * p + u) copies, p being a few times the wanted share and u a hash of
    point and tree in [0, 1). So a sample is the same on every run, a hot point sends a
    tree no more than a few samples' worth, and what is ranked per tree has that size too.
    """
    points = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    points = points.groupBy(*columns).agg(F.count(F.lit(1)).alias("_c")).withColumn("_h", F.xxhash64(*columns))
    n = df.agg(F.count(F.lit(1))).scalar()
    share = F.least(F.lit(1.0), F.lit(4.0 * samples_per_tree) / n)
    each = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.floor(F.col("_c") * F.col("_p") + hash_unit("_h", t, F.lit(seed))).alias("copies")),
    )
    drawn = points.withColumn("_p", share).withColumn("_t", F.explode(F.filter(each, lambda x: x["copies"] > 0)))
    copies = F.least("_c", F.col("_t.copies"))
    per_tree = drawn.select(*columns, "_h", F.col("_t.tree").alias("tree"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_copy"))
    # By count, so that growing the trees stays spread over the tasks although the samples are small.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_tree = per_tree.repartition(min(trees, tasks), "tree")
    order = Window.partitionBy("tree").orderBy(hash_unit("_h", "_copy", "tree", F.lit(seed)), *columns, "_copy")
    chosen = per_tree.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= samples_per_tree)
    return chosen.select("tree", *columns)


def fit_forest(
    df: DataFrame, columns: Sequence[str], trees: int = 100, seed: int = 42, samples_per_tree: int = SAMPLES_PER_TREE
) -> Forest:
    """Trees (at most two nodes a sample each) and the mean path of their sample size."""
    columns = list(columns)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = rows[columns].to_numpy(dtype=float)
        depth = math.ceil(math.log2(max(len(points), 2)))
        tree = grow_tree(points, np.random.default_rng([seed, int(key[0])]), depth)
        return pd.DataFrame([{"tree": int(key[0]), "n": len(points), **tree}])

    fitted = (
        sample_for_trees(df, columns, trees, seed, samples_per_tree)
        .groupBy("tree")
        .applyInPandas(fit, f"{TREE_SCHEMA}, n int")
        .orderBy("tree")
        .collect()
    )
    if not fitted:
        raise ValueError("a forest needs rows")
    names = ("feature", "threshold", "left", "right", "path")
    return [{n: np.asarray(row[n]) for n in names} for row in fitted], mean_path(max(row["n"] for row in fitted))


# Trees and the mean path of the samples they were grown from, as :func:`fit_forest` returns them.
Forest = tuple[list[dict], float]


def score_forest(df: DataFrame, columns: Sequence[str], forest: Forest) -> DataFrame:
    """Add ``anomaly_score``: 2 to the power of minus a row's mean path through the trees over the forest's; nulls are 0."""
    trees, unit = forest
    arrays = [{n: np.asarray(v) for n, v in tree.items()} for tree in trees]
    # At most two nodes a sample in each tree.
    shared = df.sparkSession.sparkContext.broadcast((arrays, unit or 1.0))
    # A step down leads to a later node, so no path has more steps than nodes.
    most = max((len(t["feature"]) for t in arrays), default=0)

    @pandas_udf("double")
    def score(point: pd.DataFrame) -> pd.Series:
        grown, scale = shared.value
        x = point.to_numpy(dtype=float)
        total = np.zeros(len(x))
        for tree in grown:
            total += path_lengths(x, tree, most)
        return pd.Series(np.exp2(-total / max(len(grown), 1) / scale))

    score = score.asNondeterministic()  # evaluate once per row, wherever the result is used
    features = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return df.withColumn("anomaly_score", score(features))


def detect_isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    contamination: float = 0.05,
    seed: int = 42,
    trees: int = 100,
    samples_per_tree: int = SAMPLES_PER_TREE,
    forest: Forest | None = None,
) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly_iforest`` for the share ``contamination`` of highest scores.

    With a ``forest`` its trees score the rows; without, one is grown of them. Raises ``ValueError`` for an empty frame, of which
    no forest can be grown.
    """
    forest = fit_forest(df, columns, trees, seed, samples_per_tree) if forest is None else forest
    scored = materialise(score_forest(df, columns, forest), "scored")
    cutoff = exact_quantiles(scored, [], "anomaly_score", {"cutoff": 1.0 - contamination}).scalar()
    return scored.withColumn("is_anomaly_iforest", F.col("anomaly_score") > cutoff)
