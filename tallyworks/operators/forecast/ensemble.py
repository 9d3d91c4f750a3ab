"""Tree ensembles on lagged values, one per series, grown for many series at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyworks.functions import trees as grown
from tallyworks.functions.columns import future_dates
from tallyworks.functions.lineage import materialise
from tallyworks.operators.forecast.linear import Z95
from tallyworks.operators.forecast.smoothing import fit_udf, spread_fits

FEATURES = ["lag_1", "lag_2", "lag_3", "rolling_mean_3", "rolling_std_3", "month", "quarter"]


def lag_features(series: DataFrame, keys: Sequence[str], include_current: bool = False) -> DataFrame:
    """Lags 1 to 3, mean and sample deviation of three values, month and quarter; incomplete rows left out.

    The three values are the ones before the point. ``include_current=True`` takes the point
    and the two before it, which leaks the target and is only for comparison.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    frame = w.rowsBetween(-2, 0) if include_current else w.rowsBetween(-3, -1)
    out = series.withColumns(
        {
            **{f"lag_{i}": F.lag("value", i).over(w) for i in (1, 2, 3)},
            "rolling_mean_3": F.avg("value").over(frame),
            "rolling_std_3": F.stddev_samp("value").over(frame),
            "month": F.month("date"),
            "quarter": F.quarter("date"),
            "_known": F.count("value").over(frame),
        }
    )
    return out.where("lag_3 IS NOT NULL AND _known = 3").drop("_known")


_FIT = "mae double, rmse double, r2 double, sigma double, fitted array<double>, forecast array<double>"
FOREST_DEPTH, BOOSTED_DEPTH = 10, 5


def features_of(y: np.ndarray, month: np.ndarray) -> np.ndarray:
    """The columns of ``FEATURES`` for each point of a series, those of :func:`lag_features`; NaN where one is not known."""
    before = np.full((len(y), 3), np.nan)
    for lag in (1, 2, 3):
        before[lag:, lag - 1] = y[: len(y) - lag]
    return np.column_stack([before, before.mean(1), before.std(1, ddof=1), month, (month - 1) // 3 + 1])


def fit_series(ys: list[np.ndarray], months: list[np.ndarray], periods: int, trees: int, rounds: int, seed: int) -> list[tuple | None]:
    """Metrics, fitted values and forecast of each series; None without a point that has three before it."""
    kept = []
    for i, (y, month) in enumerate(zip(ys, months)):
        x = features_of(y, month)
        known = np.isfinite(x).all(1) & np.isfinite(y)
        if known.any() and np.isfinite(y[-3:]).all():
            kept.append((i, x, known))
    out: list[tuple | None] = [None] * len(ys)
    if not kept:
        return out
    # All series' boosted trees grow together, rows that a shorter one lacks weigh nothing.
    width = max(int(known.sum()) for _, _, known in kept)
    xs, targets, weight = np.zeros((len(kept), width, len(FEATURES))), np.zeros((len(kept), width)), np.zeros((len(kept), width))
    for row, (i, x, known) in enumerate(kept):
        n = int(known.sum())
        xs[row, :n], targets[row, :n], weight[row, :n] = x[known], ys[i][known], 1.0
    boosted = grown.boosted(xs, targets, weight, rounds, BOOSTED_DEPTH)
    said = boosted.predict(xs)
    forests = []
    for row, (i, x, known) in enumerate(kept):
        n = int(known.sum())
        forests.append(grown.forest(xs[row, :n], targets[row, :n], trees, FOREST_DEPTH, seed))
        said[row, :n] = (said[row, :n] + forests[-1].predict(xs[row : row + 1, :n]).mean(0)) / 2
    last = np.array([ys[i][-3:][::-1] for i, _, _ in kept])
    month = np.array([months[i][-1] for i, _, _ in kept])
    ahead = np.zeros((len(kept), periods))
    for step in range(periods):
        month = month % 12 + 1
        x = np.column_stack([last, last.mean(1), last.std(1, ddof=1), month, (month - 1) // 3 + 1])[:, None, :]
        trees_say = np.array([f.predict(x[row : row + 1]).mean() for row, f in enumerate(forests)])
        ahead[:, step] = (boosted.predict(x)[:, 0] + trees_say) / 2
        last = np.column_stack([ahead[:, step], last[:, :2]])
    for row, (i, _, known) in enumerate(kept):
        n = int(known.sum())
        error = targets[row, :n] - said[row, :n]
        total = float(((targets[row, :n] - targets[row, :n].mean()) ** 2).sum())
        fitted = np.full(len(ys[i]), np.nan)
        fitted[known] = said[row, :n]
        out[i] = (
            float(np.abs(error).mean()), float(np.sqrt((error**2).mean())), 1 - float((error**2).sum()) / total if total > 0 else None,
            float(error.std()), [None if v != v else v for v in fitted.tolist()], ahead[row],
        )
    return out


def fit_ensemble(
    series: DataFrame, keys: Sequence[str], periods: int = 6, trees: int = 100, rounds: int = 100, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Evaluation (in-sample mae, rmse, r2, sigma and fitted values per series) and forecast rows. Monthly series.

    The mean of a random forest (depth 10) and boosted trees (depth 5) of the series' own, on three lags, the mean and the
    deviation of the three values before, month and quarter; a forecast feeds the lags of the next step. A series without a point that has
    three before it has no rows. A series is one row, as the calendar bounds it; all of a task's are fitted together.
    """
    keys = list(keys)
    points = F.sort_array(F.collect_list(F.struct("date", "value")))
    arrays = series.groupBy(*keys).agg(
        F.transform(points, lambda p: p["value"].cast("double")).alias("values"),
        F.transform(points, lambda p: F.month(p["date"])).alias("months"),
        F.max("date").alias("last_date"),
    )

    @fit_udf(_FIT)
    def fit(values: pd.Series, months: pd.Series) -> pd.DataFrame:
        ys = [np.array([np.nan if v is None else v for v in y], dtype=float) for y in values]
        made = fit_series(ys, [np.asarray(m, dtype=float) for m in months], periods, trees, rounds, seed)
        names = [part.split()[0] for part in _FIT.split(", ")]
        return pd.DataFrame([m or (None,) * len(names) for m in made], columns=names)

    fitted = materialise(spread_fits(arrays, keys).withColumn("_fit", fit("values", "months")).select(*keys, "last_date", "_fit.*"), "ensemble")
    fitted = fitted.where("mae IS NOT NULL")
    evaluation = fitted.select(*keys, "mae", "rmse", "r2", "sigma", "fitted")
    steps = F.inline(F.arrays_zip(future_dates("last_date", periods, "M").alias("_at"), "forecast"))
    ahead = fitted.select(*keys, "sigma", steps)
    forecast = ahead.select(
        *keys, F.col("_at.step").alias("step"), F.col("_at.date").alias("date"), "forecast",
        (F.col("forecast") - Z95 * F.col("sigma")).alias("lower_ci"), (F.col("forecast") + Z95 * F.col("sigma")).alias("upper_ci"),
    )
    return evaluation, forecast
