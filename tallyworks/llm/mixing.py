"""Mixing sources to target weights by capped water-filling.

Every source is to give ``budget`` times its share of the weights. A source that would have to
be read more than ``max_epochs`` times is held there, and what it leaves is shared among the
others by weight, until no source is above its cap. A source's target is then met by whole
repetitions of all its documents and one more of the documents that come first in a seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tallyworks.functions.lineage import materialise
from tallyworks.llm.common import ROW, n_words, numbered, row_only, with_row

# Slices of a source in the seeded order: the first three hexadecimal digits of the order key.
SLICE_DIGITS = 3


@dataclass(frozen=True)
class Mixture:
    """``sources``: source, weight, size, target, whole (repetitions of every document), last
    (the order key up to which a document comes once more; null: none).
    ``rows``: the caller's row, its source, size and order key."""

    sources: DataFrame
    rows: DataFrame


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Sources with weights ``cycle`` over and over, by code point, a null source last."""
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", weight).drop("rank")


def filled(sources: DataFrame, budget: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """``sources`` (source, size, weight) with ``target``.

    Each round needs one row of sums: the level of the water, which only rises, says who is
    capped. ``budget`` is the number of words wanted, by default all words of all sources.
    A budget beyond all caps leaves every source at its cap.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("size").alias("size")).first()["size"] if budget is None else budget
    held, weights = 0.0, None
    while True:
        above = F.lit(False) if weights is None else cap * F.lit(weights) <= F.col("weight") * F.lit(total - held)
        sums = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("held"), F.sum(F.when(~above, F.col("weight")).otherwise(0.0)).alias("weights")
        ).first()
        if (sums["held"], sums["weights"]) == (held, weights) or not sums["weights"]:
            break
        held, weights = sums["held"], sums["weights"]
    if total is None or not sums["weights"]:
        return sources.withColumn("target", F.when(F.col("weight") > 0, cap).otherwise(F.lit(0.0)))
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(total - held)) / F.lit(weights)))


def mixture(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float | None = None,
    max_epochs: float = 3.0,
    seed: int = 0,
) -> Mixture:
    """The plan of a mix: what each source gives and where its last repetition ends.

    ``weights`` (source, weight) names the target weights; sources without one get none and give
    nothing. By default sources weigh 1, 2, 3 over and over. A document's size is its number of
    words; null texts have none. A null source is a source. Repeated rows share their place in
    the seeded order and are taken alike. An empty table gives an empty mix.

    Only sums by source and slice of the order are shuffled, so a source with most rows is no
    hot key; the slice in which a source's last repetition ends is looked at row by row.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string"), F.md5(F.col(f"`{text_col}`").cast("binary"))))
    rows = with_row(docs, source=F.col(f"`{source_col}`").cast("string"), size=n_words(F.col(f"`{text_col}`")), key=key)
    rows = rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("size")), "slices")
    sources = slices.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weighed = cycled_weights(sources)
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighed = sources.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").na.fill(0.0, ["weight"])
    sources = filled(materialise(weighed, "sources"), budget, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    sources = materialise(sources, "targets")

    # The slice in which the last repetition ends, then the document in it.
    rest = sources.select(F.col("source").alias("_source"), "rest").where("rest > 0")
    upto = Window.partitionBy("source").orderBy("slice")
    inside = slices.where("size > 0").join(rest, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "slice", "rest", F.sum("size").over(upto).alias("end"), F.col("size").alias("slice_size")
    )
    inside = inside.where("end - slice_size < rest AND rest <= end").select(
        F.col("source").alias("_source"), F.col("slice").alias("_slice"), (F.col("rest") - F.col("end") + F.col("slice_size")).alias("left")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))
    keys = rows.select("source", "slice", "size", "key").where("size > 0").join(materialise(inside, "edges"), same)
    keys = keys.groupBy("source", "slice", "key").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    upto = Window.partitionBy("source", "slice").orderBy("key")
    keys = keys.withColumn("end", F.sum("size").over(upto))
    # A document belongs to the mix if at least half of it lies before the end.
    last = keys.groupBy("source", "slice").agg(F.max(F.when(F.col("end") - F.col("size") / 2 <= F.col("left"), F.col("key"))).alias("last"))
    last = last.select(F.col("source").alias("_source"), F.coalesce("last", "slice").alias("last"))
    sources = sources.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
    return Mixture(materialise(sources.select("source", "weight", "size", "target", "whole", "last"), "mixture"), rows)


def taken(plan: Mixture) -> DataFrame:
    """Every row (``_row``) with source, size, ``source_size``, ``target`` and ``copies``."""
    of = plan.sources.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "whole", "last")
    once_more = F.coalesce((F.col("key") <= F.col("last")).cast("long"), F.lit(0).cast("long"))
    joined = plan.rows.join(of, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(ROW, "source", "size", "source_size", "target", (F.col("whole") + once_more).alias("copies"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The mixed table: the columns of ``docs``, each row as often as the mix takes it."""
    rows = taken(mixture(docs, weights, **options)).where("copies > 0")
    return row_only(rows.select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))

