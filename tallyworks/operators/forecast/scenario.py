"""Planning scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyworks.functions.columns import explode_future

# Growth factor and level factor of each scenario.
SCENARIOS = [("Expected", 1.0, 1.0), ("Optimistic", 1.2, 1.0), ("Conservative", 1.0, 0.9)]


def scenario_forecasts(series: DataFrame, keys: Sequence[str], periods: int = 6) -> DataFrame:
    """(keys, scenario, step, date, forecast): mean growth continued from the last value, never below 0."""
    trend = series.groupBy(*keys).agg(
        F.max_by("value", "date").alias("last"),
        F.min_by("value", "date").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.max("date").alias("last_date"),
    )
    growth = (F.col("last") - F.col("first")) / F.col("n")
    point = F.greatest(F.col("last") + growth * F.col("growth_factor") * F.col("step"), F.lit(0.0)) * F.col("level_factor")
    variants = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), F.lit(g).alias("growth_factor"), F.lit(f).alias("level_factor"))
            for s, g, f in SCENARIOS
        ]
    )
    ahead = explode_future(trend, "last_date", periods).select("*", F.inline(variants))
    return ahead.select(*keys, "scenario", "step", "date", point.alias("forecast"))


def scenario_means(scenarios: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scenarios.groupBy(*keys, "scenario").agg(F.avg("forecast").alias("mean_forecast"))


def with_accuracy(evaluation: DataFrame) -> DataFrame:
    return evaluation.withColumn("accuracy", 100 - F.col("smape"))


def bound_summary(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scenario, average, total) of the lower bound, the forecast and the upper bound."""
    bounds = [("Conservative", "lower_ci"), ("Expected", "forecast"), ("High Demand", "upper_ci")]
    rows = [F.struct(F.lit(s).alias("scenario"), F.col(c).alias("value")) for s, c in bounds]
    return (
        forecast.select(*keys, F.inline(F.array(*rows)))
        .groupBy(*keys, "scenario")
        .agg(F.avg("value").alias("average"), F.sum("value").alias("total"))
    )
