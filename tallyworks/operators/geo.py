"""Figures behind the maps: aggregates, coordinates, shades and layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.operators.stats import with_group_stats
from tallyworks.sources.coordinates import DEFAULT_CENTRE, state_coordinates

# Distance in degrees of a district marker from the centre of its state.
DISTRICT_RADIUS = 0.5


def _map_figures(df: DataFrame, keys: list[str]) -> DataFrame:
    sums = ("total_enrolment", "total_updates", "total_demo_updates", "total_bio_updates")
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.avg("update_pressure_index").alias("update_pressure_index")
    )


def state_figures(df: DataFrame) -> DataFrame:
    return _map_figures(df, ["state"])


def district_figures(df: DataFrame, state: str | None = None) -> DataFrame:
    """By district of one state, or of all."""
    return _map_figures(df if state is None else df.where(F.col("state") == state), ["state", "district"])


def with_coordinates(df: DataFrame, default: bool = False) -> DataFrame:
    """Latitude and longitude of the state; unknown states are left out, or put at the default centre.

    The 36 coordinate rows are a fixed table, so they are broadcast.
    """
    known = F.broadcast(state_coordinates(df.sparkSession))
    if not default:
        return df.join(known, "state")
    lat, lon = DEFAULT_CENTRE
    return df.join(known, "state", "left").withColumns(
        {"lat": F.coalesce("lat", F.lit(lat)), "lon": F.coalesce("lon", F.lit(lon))}
    )


def normalise(df: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    """Add ``normalized``: the metric from 0 (least) to 1 (greatest), 0.5 where all are equal."""
    df = with_group_stats(df, keys or [], {"_lo": F.min(metric), "_hi": F.max(metric)})
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, F.try_divide((F.col(metric) - F.col("_lo")).cast("double"), span.cast("double"))).otherwise(0.5)
    return df.withColumn("normalized", value).drop("_lo", "_hi")


def state_shade(normalized: Column | str = "normalized") -> Column:
    n = F.col(normalized) if isinstance(normalized, str) else normalized
    return F.when(n < 0.33, "green").when(n < 0.67, "orange").otherwise("red")


def district_shade(normalized: Column | str = "normalized") -> Column:
    n = F.col(normalized) if isinstance(normalized, str) else normalized
    return F.when(n > 0.67, "red").when(n > 0.33, "orange").otherwise("green")


def state_markers(df: DataFrame, metric: str = "total_enrolment") -> DataFrame:
    """One marker per known state; shade and size are relative to all states, known or not."""
    shaded = normalise(state_figures(df), metric)
    return with_coordinates(shaded).withColumn("color", state_shade()).withColumn("radius", 10 + F.col("normalized") * 30)


def district_layout(df: DataFrame) -> DataFrame:
    """Spread the districts of each state evenly on a circle around its centre, in order of name.

    ``df`` has one row per district and the ``lat``/``lon`` of its state.
    """
    w = Window.partitionBy("state")
    angle = (F.row_number().over(w.orderBy("district")) - 1) / F.count(F.lit(1)).over(w) * (2 * math.pi)
    return (
        df.withColumn("_a", angle)
        .withColumn("lat", F.col("lat") + F.cos("_a") * DISTRICT_RADIUS)
        .withColumn("lon", F.col("lon") + F.sin("_a") * DISTRICT_RADIUS)
        .drop("_a")
    )


def district_markers(df: DataFrame, state: str | None = None, metric: str = "total_enrolment") -> DataFrame:
    """One marker per district of one state, or of all states at once."""
    shaded = normalise(district_figures(df, state), metric, ["state"])
    placed = district_layout(with_coordinates(shaded, default=True))
    return placed.withColumn("color", district_shade()).withColumn("radius", 8 + F.col("normalized") * 15)


def map_statistics(df: DataFrame) -> DataFrame:
    """States covered, the one with most enrolments, how many lie above the mean index, mean per state."""
    states = state_figures(df)
    mean = states.agg(F.avg("update_pressure_index")).scalar()
    return states.withColumn("_mean", mean).agg(
        F.count(F.lit(1)).alias("states"),
        F.min_by("state", F.struct(F.negative("total_enrolment"), F.col("state"))).alias("top_state"),
        F.count_if(F.col("update_pressure_index") > F.col("_mean")).alias("high_pressure_states"),
        F.avg("total_enrolment").alias("avg_enrolment_per_state"),
    )
