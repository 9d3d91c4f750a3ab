"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyworks.functions.lineage import materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours ``v``; partial minima meet, not links."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_nearest(both), F.col("u") == F.col("n"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    joined = down.join(near, F.col("u") == F.col("n"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): every linked node with the least node it reaches, itself included.

    Links of a node to itself and repeated links change nothing; nulls are no nodes. No link, no row.
    Large-star and small-star steps alternate until the links are stars, each round cut from the
    one before by a written table. Rounds grow with the logarithm of the nodes.
    """
    edges = materialise(links.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        edges = materialise(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
