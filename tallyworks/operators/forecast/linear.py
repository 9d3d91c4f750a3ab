"""Straight-line trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.columns import explode_future
from tallyworks.operators.forecast.evaluate import r_squared, with_position

Z95 = 1.96


def direction(slope: Column) -> Column:
    return F.when(slope > 0, "Increasing").when(slope < 0, "Decreasing").otherwise("Stable")


def line(value: Column, i: Column, keys: Sequence[str]) -> tuple[Column, Column]:
    """Slope and intercept over the non-null values of a series; a single point is a flat line."""
    w = Window.partitionBy(*keys)
    slope = F.coalesce(F.regr_slope(value, i).over(w), F.lit(0.0))
    return slope, F.coalesce(F.regr_intercept(value, i).over(w), F.avg(value).over(w))


def fit_line(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: slope, intercept, direction, in-sample errors, spread of the residuals."""
    rows = with_position(series, keys)
    slope, intercept = line(F.col("value"), F.col("i"), keys)
    rows = rows.withColumns({"slope": slope, "intercept": intercept})
    rows = rows.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("i"))
    error = F.col("value") - F.col("fitted")
    return (
        rows.groupBy(*keys)
        .agg(
            F.first("slope").alias("slope"),
            F.first("intercept").alias("intercept"),
            F.count(F.lit(1)).alias("n"),
            F.max("date").alias("last_date"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            r_squared("value", "fitted").alias("r2"),
            F.stddev_pop(error).alias("sigma"),
        )
        .withColumn("trend_direction", direction(F.col("slope")))
    )


def forecast_line(fit: DataFrame, keys: Sequence[str], periods: int = 6, freq: str = "M") -> DataFrame:
    """The line continued, labelled by the last day of each period, with a constant band and no clipping."""
    ahead = explode_future(fit, "last_date", periods, freq)
    point = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    return ahead.select(
        *keys,
        "step",
        "date",
        point.alias("forecast"),
        (point - Z95 * F.col("sigma")).alias("lower_ci"),
        (point + Z95 * F.col("sigma")).alias("upper_ci"),
    )


def widening_band(point: Column, sigma: Column, step: Column) -> tuple[Column, Column, Column]:
    """Forecast and bounds clipped at 0, the band growing with the root of the step."""
    point = F.greatest(point, F.lit(0.0))
    reach = Z95 * sigma * F.sqrt(step)
    return point, F.greatest(point - reach, F.lit(0.0)), point + reach


def forecast_trend(fit: DataFrame, keys: Sequence[str], periods: int = 6) -> DataFrame:
    """The line continued from the first of next month, never below 0, with a widening band."""
    ahead = explode_future(fit, "last_date", periods)
    raw = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    point, lower, upper = widening_band(raw, F.col("sigma"), F.col("step"))
    return ahead.select(*keys, "step", "date", point.alias("forecast"), lower.alias("lower_ci"), upper.alias("upper_ci"))
