"""Additive or multiplicative model of trend, sparse trend changes and yearly season, one row per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyworks.functions import structural
from tallyworks.functions.columns import future_dates
from tallyworks.operators.forecast.smoothing import as_arrays, fit_udf, spread_fits

MODES = ("additive", "multiplicative")
_FIT = (
    "forecast array<double>, lower array<double>, upper array<double>, fitted array<double>, trend_changes array<double>, "
    "mae double, rmse double, r2 double"
)


def fit_structural(
    series: DataFrame, keys: Sequence[str], periods: int = 6, changepoint_scale: float = 0.05, season_scale: float = 10.0, mode: str = "additive"
) -> DataFrame:
    """One row per series: in-sample metrics, fitted values and a forecast with 80 % bounds. Monthly series.

    Changes of trend are held back by ``changepoint_scale``, which leaves most of them at 0 (``trend_changes`` has them, per
    length of the series), waves by ``season_scale``. With ``mode`` "multiplicative" the season is a share of
    the trend. The bounds are quantiles of simulated futures, in which the trend changes on as it did.
    """
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")

    @fit_udf(_FIT)
    def fit(values: pd.Series, last_month: pd.Series) -> pd.DataFrame:
        rows = []
        for y, month in zip(values, last_month):
            y = np.asarray(y, dtype=float)
            model = structural.fit(y, int(month), changepoint_scale, season_scale, mode == "multiplicative")
            fitted = model.predict(np.arange(len(y)))
            lower, upper = model.interval(periods)
            error = y - fitted
            total = float(((y - y.mean()) ** 2).sum())
            rows.append(
                (model.predict(np.arange(len(y), len(y) + periods)), lower, upper, fitted, model.changes * model.scale,
                 float(np.abs(error).mean()), float(np.sqrt((error**2).mean())), 1 - float((error**2).sum()) / total if total > 0 else None)
            )
        return pd.DataFrame(rows, columns=[part.split()[0] for part in _FIT.split(", ")])

    fitted = spread_fits(as_arrays(series, keys), keys).withColumn("_fit", fit("values", F.month("last_date")))
    return fitted.select(*keys, "n", "last_date", "_fit.*")


def forecast_structural(fit: DataFrame, keys: Sequence[str], periods: int = 6, freq: str = "M") -> DataFrame:
    steps = F.inline(F.arrays_zip(future_dates("last_date", periods, freq).alias("_at"), "forecast", "lower", "upper"))
    return fit.select(*keys, steps).select(
        *keys, F.col("_at.step").alias("step"), F.col("_at.date").alias("date"),
        "forecast", F.col("lower").alias("lower_ci"), F.col("upper").alias("upper_ci"),
    )
