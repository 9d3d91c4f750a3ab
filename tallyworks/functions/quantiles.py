"""Exact, linearly interpolated quantiles that never gather a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.lineage import materialise

# Rank error of the sketch that brackets a quantile is one part in this many.
SKETCH_ACCURACY = 10_000
# A bracket with more distinct values than one task is to sort is narrowed, each time to one or two of so many parts of
# about as many values, until it has no more. The sketch leaves one in 1,250 of a group's values at most.
SORTED, PARTS = 100_000, 256


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join, also null to null."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])
    return left.join(right, on).drop(*[f"_r{k}" for k in keys])


# The two ranks between which a quantile lies.
_ENDS = (("_lo", F.floor), ("_hi", F.ceil))


def _narrowed(inside: DataFrame, by: list[str]) -> DataFrame:
    """Of each bracket's values (``_x``, ``_n`` rows each, ``_below`` rows under them) the parts with the ranks around ``_h``."""
    shares = [k / PARTS for k in range(1, PARTS)]
    splitters = inside.groupBy(*by).agg(F.percentile_approx("_x", shares, SKETCH_ACCURACY).alias("_s"))
    # A value belongs to the part after the splitters below it.
    part = F.size(F.filter("_s", lambda s: s < F.col("_x")))
    parted = _join(inside, splitters, by).withColumn("_part", part).drop("_s")
    sizes = parted.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"), F.first("_h").alias("_h"), F.first("_below").alias("_below"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_size").over(before), F.lit(0)))
    wanted = (F.col("_from") <= F.ceil("_h")) & (F.col("_from") + F.col("_size") > F.floor("_h"))
    kept = sizes.where(wanted)
    # The rows below the first part that stays.
    first = kept.groupBy(*by).agg(F.min("_from").alias("_below"))
    stays = _join(kept.select(*by, "_part"), first, by)
    return _join(parted.drop("_below"), stays, [*by, "_part"]).drop("_part")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per wanted quantile, e.g. ``{"q1": 0.25}``.

    A mergeable sketch brackets each quantile and ranks are counted exactly; what lies in a bracket is written. While one holds more
    than ``SORTED`` values they are split into parts of about equal size, by splitters from a sketch of theirs, and only the
    parts that hold the wanted ranks stay. Nulls and NaN are left out. Equal values are counted together
    first, so a hot group is spread over its values.
    """
    names = list(probs)
    margin = 4.0 / SKETCH_ACCURACY
    bounds = [max(0.0, p - margin) for p in probs.values()] + [min(1.0, p + margin) for p in probs.values()]
    group = keys or ["_all"]
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, known.alias("_x")).where("_x IS NOT NULL")

    sketch_columns = [
        F.count(F.lit(1)).alias("_total"),
        F.percentile_approx("_x", bounds, SKETCH_ACCURACY).alias("_b"),
    ]
    counts = rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        bracketed = _join(counts, rows.groupBy(*keys).agg(*sketch_columns), keys)
    else:
        sketch = rows.agg(F.struct(*sketch_columns).alias("_s")).scalar()
        bracketed = counts.withColumn("_s", sketch).select("*", "_s._total", "_s._b", F.lit(0).alias("_all"))

    def bracket(i: int, p: float) -> Column:
        lo, hi = F.col("_b")[i], F.col("_b")[i + len(names)]
        zone = F.when(F.col("_x") < lo, -1).when(F.col("_x") > hi, 1).otherwise(0)
        return F.struct(F.lit(i).alias("_i"), zone.alias("_zone"), ((F.col("_total") - 1) * p).alias("_h"))

    per_prob = bracketed.select(
        *group, "_x", "_n", F.inline(F.array(*[bracket(i, p) for i, p in enumerate(probs.values())]))
    )
    by_prob = [*group, "_i"]

    # Outside the bracket only the neighbouring value matters, and how many rows lie below: a row for each side.
    own = F.when(F.col("_zone") == 0, F.col("_x")).alias("_own")
    sums = [F.sum("_n").alias("_n"), F.first("_h").alias("_h"), F.min("_x").alias("_least"), F.max("_x").alias("_most")]
    staged = materialise(per_prob.groupBy(*by_prob, "_zone", own).agg(*sums), "brackets")
    zone = F.col("_zone")
    edges = staged.groupBy(*by_prob).agg(
        F.first("_h").alias("_h"),
        F.coalesce(F.sum(F.when(zone < 0, F.col("_n"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(zone == 0, F.col("_n"))), F.lit(0)).alias("_inside"),
        F.max(F.when(zone < 0, F.col("_most"))).alias("_pred"),
        F.min(F.when(zone > 0, F.col("_least"))).alias("_succ"),
    )
    inside = _join(staged.where("_zone = 0").select(*by_prob, "_h", F.col("_own").alias("_x"), "_n"), edges.select(*by_prob, "_below"), by_prob)
    # No bracket holds more than all of them, which a count tells without a shuffle.
    held = staged.where("_zone = 0").count()
    while held > SORTED:
        held = inside.groupBy(*by_prob).count().agg(F.max("count")).first()[0] or 0
        if held > SORTED:
            inside = materialise(_narrowed(inside, by_prob), "narrowed")

    running = Window.partitionBy(*by_prob).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.col("_below") + F.sum("_n").over(running))
    found = ranked.groupBy(*by_prob).agg(*[F.min(F.when(F.col("_upto") > at("_h"), F.col("_x"))).alias(n) for n, at in _ENDS])
    # A rank right beside the bracket is the neighbouring value's.
    beside = [
        F.when(at("_h") < F.col("_below"), F.col("_pred")).when(at("_h") >= F.col("_below") + F.col("_inside"), F.col("_succ")).otherwise(F.col(n)).alias(n)
        for n, at in _ENDS
    ]
    at = _join(edges, found, by_prob).select(*by_prob, "_h", *beside)
    fraction = F.col("_h") - F.floor("_h")
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction
    out = at.groupBy(*group).agg(*[F.max(F.when(F.col("_i") == i, point)).alias(n) for i, n in enumerate(names)])
    return out.select(*keys, *names)
