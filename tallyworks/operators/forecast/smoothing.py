"""Exponential smoothing of every series, one row and one fit per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.functions import smoothing
from tallyworks.functions.columns import explode_future
from tallyworks.operators.forecast.linear import Z95, widening_band


def as_arrays(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: ``values`` in order of date, ``n`` and ``last_date``."""
    points = F.sort_array(F.collect_list(F.struct("date", "value")))
    return series.groupBy(*keys).agg(
        F.transform(points, lambda p: p["value"]).alias("values"),
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max("date").alias("last_date"),
    )


def fit_udf(schema: str):
    """A pandas UDF run once per row: a deterministic one may be repeated by filters and projections above it."""

    def wrap(fn):
        return F.pandas_udf(fn, schema).asNondeterministic()

    return wrap


def spread_fits(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One fit per row is heavy work on few bytes: spread the rows by count, or AQE would merge them by size."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, F.xxhash64(*keys) if keys else F.lit(0))


_HOLT = "alpha double, beta double, phi double, level double, trend double, sse double, sae double, se double"
_WINTERS = (
    "alpha double, beta double, gamma double, level double, trend double, season array<double>, "
    "sse double, sae double, se double"
)


def _sums(errors: np.ndarray) -> tuple[float, float, float]:
    return float((errors**2).sum()), float(np.abs(errors).sum()), float(errors.sum())


def _frame(rows: list[tuple | None], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return pd.DataFrame([r or (None,) * len(names) for r in rows], columns=names)


def fit_holt(df: DataFrame, values: str = "values", out: str = "holt", weights: Sequence[float] | None = None) -> DataFrame:
    """Add the struct ``out`` to ``as_arrays`` rows: parameters, final state, sums of errors; needs two points.

    Weights and starting states are those of least squared error together. Given ``weights`` (alpha, beta, phi) start from
    the first value and the first difference.
    """

    def fit_one(y: np.ndarray) -> tuple | None:
        if len(y) < 2:
            return None
        best, states, errors = smoothing.fit_holt(y, weights)
        return (*best, *states, *_sums(errors))

    @fit_udf(_HOLT)
    def fit(series: pd.Series) -> pd.DataFrame:
        return _frame([fit_one(np.asarray(y, dtype=float)) for y in series], _HOLT)

    fitted = df.withColumn(out, fit(values))
    return fitted.withColumn(out, F.when(F.col(out)["level"].isNotNull(), F.col(out)))


def holt_point(state: Column, step: Column) -> Column:
    """Level plus the damped trend summed over the steps."""
    phi = state["phi"]
    return state["level"] + state["trend"] * phi * (1 - F.pow(phi, step)) / (1 - phi)


def residual_spread(state: Column, count: Column) -> Column:
    """Population deviation of the one-step errors."""
    mean = state["se"] / count
    return F.sqrt(F.greatest(state["sse"] / count - mean * mean, F.lit(0.0)))


def forecast_holt(fit: DataFrame, keys: Sequence[str], periods: int = 6, state: str = "holt") -> DataFrame:
    """Never below 0, with a band growing with the root of the step."""
    ahead = explode_future(fit.where(F.col(state).isNotNull()), "last_date", periods)
    sigma = residual_spread(F.col(state), F.col("n"))
    point, lower, upper = widening_band(holt_point(F.col(state), F.col("step")), sigma, F.col("step"))
    return ahead.select(*keys, "step", "date", point.alias("forecast"), lower.alias("lower_ci"), upper.alias("upper_ci"))


def fit_winters(df: DataFrame, period: int = 12, values: str = "values", out: str = "winters", weights: Sequence[float] | None = None) -> DataFrame:
    """Additive trend and season on ``as_arrays`` rows; needs two full periods, else null.

    Weights and starting states are those of least squared error together. Given ``weights`` (alpha, beta, gamma) start from
    the first period and the mean step to the second.
    """

    def fit_one(y: np.ndarray) -> tuple | None:
        if len(y) < 2 * period:
            return None
        best, states, errors = smoothing.fit_winters(y, period, weights)
        return (*best, *states[:2], states[2:], *_sums(errors))

    @fit_udf(_WINTERS)
    def fit(series: pd.Series) -> pd.DataFrame:
        return _frame([fit_one(np.asarray(y, dtype=float)) for y in series], _WINTERS)

    fitted = df.withColumn(out, fit(values))
    return fitted.withColumn(out, F.when(F.col(out)["level"].isNotNull(), F.col(out)))


def winters_metrics(state: Column, n: Column) -> tuple[Column, Column]:
    """In-sample MAE and RMSE."""
    return state["sae"] / n, F.sqrt(state["sse"] / n)


def forecast_winters(
    fit: DataFrame, keys: Sequence[str], periods: int = 6, period: int = 12, state: str = "winters", freq: str = "M"
) -> DataFrame:
    """Labelled by the last day of each period, with a constant band and no clipping."""
    ahead = explode_future(fit.where(F.col(state).isNotNull()), "last_date", periods, freq)
    s, step = F.col(state), F.col("step")
    point = s["level"] + s["trend"] * step + s["season"][(step - 1) % period]
    sigma = residual_spread(s, F.col("n"))
    return ahead.select(
        *keys, "step", "date", point.alias("forecast"),
        (point - Z95 * sigma).alias("lower_ci"), (point + Z95 * sigma).alias("upper_ci"),
    )
