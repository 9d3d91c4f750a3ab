"""ARIMA family and stationarity test, one task slot per fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyworks.functions import arima
from tallyworks.functions.columns import future_dates
from tallyworks.operators.forecast.linear import fit_line, forecast_line
from tallyworks.operators.forecast.smoothing import as_arrays, fit_udf, spread_fits

NO_SEASON = (0, 0, 0, 0)
SEASONAL_ORDER = (1, 1, 1, 12)

_FIT = (
    "failed boolean, predicted array<double>, fitted array<double>, forecast array<double>, lower array<double>, upper array<double>, "
    "mae double, rmse double, smape double, r2 double, n_test int"
)
_FAILED = {
    "failed": True, "predicted": None, "fitted": None, "forecast": None, "lower": None, "upper": None,
    "mae": None, "rmse": None, "smape": None, "r2": None, "n_test": None,
}


def _metrics(actual: np.ndarray, predicted: np.ndarray) -> dict[str, float]:
    error = actual - predicted
    size = (np.abs(actual) + np.abs(predicted)) / 2
    counted = size > 1e-10
    total = float(((actual - actual.mean()) ** 2).sum())
    return {
        "mae": float(np.abs(error).mean()),
        "rmse": float(np.sqrt((error**2).mean())),
        "smape": float((np.abs(error[counted]) / size[counted]).mean() * 100) if counted.any() else 0.0,
        "r2": 1 - float((error**2).sum()) / total if total > 0 else 0.0,
    }


def _fits(ys: Sequence[np.ndarray], orders: Sequence, seasonal, skips: Sequence[int] | None = None) -> list[arima.Arima | None]:
    """A fit of each series, all at once; None where one is too short or its equations have no solution."""
    seasonals = [tuple(seasonal)] * len(ys)
    try:
        return arima.fit_many(ys, orders, seasonals, skips)
    except np.linalg.LinAlgError:
        # One of them has none; found by fitting each alone.
        alone = []
        for i, y in enumerate(ys):
            try:
                alone += arima.fit_many([y], [orders[i]], seasonals[:1], None if skips is None else [skips[i]])
            except np.linalg.LinAlgError:
                alone.append(None)
        return alone


def _line_metrics(train: np.ndarray, test: np.ndarray) -> dict:
    """Metrics of the straight line that takes over from a failed model; none without points to judge by."""
    if len(train) == 0 or len(test) == 0 or not np.isfinite([*train, *test]).all():
        return {}
    slope, level = np.polyfit(np.arange(len(train)), train, 1) if len(train) > 1 else (0.0, train[0])
    return {**_metrics(test, level + slope * np.arange(len(train), len(train) + len(test))), "n_test": len(test)}


def fit_arima(
    series: DataFrame,
    keys: Sequence[str],
    order=(1, 1, 1),
    seasonal=NO_SEASON,
    periods: int = 12,
    n_test: int = 6,
    clip_test: bool = False,
    order_column: str | None = None,
) -> DataFrame:
    """One row per series: hold-out metrics, fitted values, forecast with 95 % bounds (not below 0), ``failed``.

    The model is fitted without the last ``n_test`` points, judged on them, then fitted on
    all. ``fitted`` has what the latter expects of each point given those before, null for the points that
    differencing takes. ``order_column`` takes (p, d, q) from a column of the series in place of ``order``. A failed
    series has the metrics of its straight line, which also forecasts it (:func:`arima_forecast`).
    """
    arrays = as_arrays(series, [*keys, order_column] if order_column else keys)
    given = F.col(order_column) if order_column else F.array(*[F.lit(int(o)) for o in order])

    @fit_udf(_FIT)
    def fit(values: pd.Series, orders: pd.Series) -> pd.DataFrame:
        rows = []
        ys = [np.asarray(y, dtype=float) for y in values]
        chosen = [tuple(int(v) for v in o) for o in orders]
        splits = [len(y) - n_test if len(y) > n_test else int(len(y) * 0.8) for y in ys]
        trains = [y[:split] for y, split in zip(ys, splits)]
        both = _fits([*trains, *ys], [*chosen, *chosen], seasonal)
        for y, train, split, judged, final in zip(ys, trains, splits, both, both[len(ys) :]):
            test = y[split:]
            if judged is None or final is None or len(test) == 0:
                rows.append(_FAILED | _line_metrics(train, test))
                continue
            predicted, _ = arima.forecast(train, judged, len(test))
            if clip_test:
                predicted = np.maximum(predicted, 0.0)
            point, spread = arima.forecast(y, final, periods)
            rows.append(
                {
                    "failed": False,
                    "predicted": predicted,
                    "fitted": [None if v != v else v for v in arima.fitted_values(y, final).tolist()],
                    "forecast": np.maximum(point, 0.0),
                    "lower": np.maximum(point - arima.Z95 * spread, 0.0),
                    "upper": np.maximum(point + arima.Z95 * spread, 0.0),
                    **_metrics(test, predicted),
                    "n_test": len(test),
                }
            )
        return pd.DataFrame(rows, columns=list(_FAILED))

    fitted = spread_fits(arrays, keys).withColumn("_fit", fit("values", given))
    return fitted.select(*keys, "n", "last_date", *([order_column] if order_column else []), "_fit.*")


def arima_forecast(fit: DataFrame, series: DataFrame, keys: Sequence[str], periods: int = 12, method: str = "arima", freq: str = "M") -> DataFrame:
    """Forecast rows; a series whose model failed is continued by its straight line."""
    steps = F.inline(F.arrays_zip(future_dates("last_date", periods, freq).alias("_at"), "forecast", "lower", "upper"))
    done = fit.where(~F.col("failed")).select(*keys, steps).select(
        *keys, F.col("_at.step").alias("step"), F.col("_at.date").alias("date"), F.lit(method).alias("method"),
        "forecast", F.col("lower").alias("lower_ci"), F.col("upper").alias("upper_ci"),
    )
    rest = series.join(fit.where("failed").select(*keys), list(keys), "left_semi")
    line = forecast_line(fit_line(rest, keys), keys, periods, freq).withColumn("method", F.lit("linear"))
    return done.unionByName(line)


def likelihood(series: DataFrame, keys: Sequence[str], order, params: Sequence[float], seasonal=NO_SEASON) -> DataFrame:
    """Exact log-likelihood, variance and AIC of every series under given parameters (autoregression, moving average, both of the
    season, and the mean where nothing is differenced); null where a series is too short."""
    if len(params) != arima.n_params(order, seasonal):
        raise ValueError(f"{order} {seasonal} has {arima.n_params(order, seasonal)} parameters")

    @fit_udf("sigma2 double, loglik double, aic double")
    def judged(values: pd.Series) -> pd.DataFrame:
        models = [arima.likelihood(np.asarray(y, dtype=float), order, seasonal, np.asarray(params)) for y in values]
        return pd.DataFrame([(m.sigma2, m.loglik, m.aic) if m else (None,) * 3 for m in models], columns=["sigma2", "loglik", "aic"])

    return as_arrays(series, keys).withColumn("_l", judged("values")).select(*keys, "n", "_l.*")


def order_search(series: DataFrame, keys: Sequence[str], max_p: int = 3, max_d: int = 2, max_q: int = 3) -> DataFrame:
    """AIC of every order for every series; each (series, order) is a row of its own, so the grid runs in parallel.

    A difference costs a point. So that AIC values of different ``d`` can be compared, all of a series speak of the points after
    the first ``max_d``, given those.
    """
    orders = [(p, d, q) for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)]
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("pdq", o)]) for o in orders])

    @fit_udf("double")
    def aic(values: pd.Series, p: pd.Series, d: pd.Series, q: pd.Series) -> pd.Series:
        orders = [tuple(int(v) for v in o) for o in zip(p, d, q)]
        fits = _fits([np.asarray(y, dtype=float) for y in values], orders, NO_SEASON, [max_d - o[1] for o in orders])
        return pd.Series([f.aic if f is not None else None for f in fits], dtype="float64")

    tried = spread_fits(as_arrays(series, keys).select(*keys, "values", F.inline(grid)), [*keys, "p", "d", "q"])
    score = aic("values", "p", "d", "q")
    return tried.withColumn("aic", F.nanvl(score, F.lit(None))).drop("values")


def best_order(search: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, order, aic) with the least AIC, the smaller order of equals; (1, 1, 1) if none could be fitted."""
    order = F.array("p", "d", "q")
    best = search.groupBy(*keys).agg(
        F.min_by(order, F.when(F.col("aic").isNotNull(), F.struct("aic", order.alias("o")))).alias("order"), F.min("aic").alias("aic")
    )
    return best.withColumn("order", F.coalesce("order", F.array(F.lit(1), F.lit(1), F.lit(1))))


def fit_best_arima(series: DataFrame, keys: Sequence[str], periods: int = 12, seasonal=NO_SEASON, **limits) -> DataFrame:
    """:func:`fit_arima` with the order the search picks for each series."""
    chosen = best_order(order_search(series, keys, **limits), keys).select(*keys, "order")
    return fit_arima(series.join(chosen, list(keys)), keys, seasonal=seasonal, periods=periods, order_column="order")


def sarima_pipeline(series: DataFrame, keys: Sequence[str], periods: int = 12, n_test: int = 6) -> DataFrame:
    """Seasonal model (1,1,1)(1,1,1,12) with ``status``: ``ok``, ``too short`` (below 12 months) or ``failed``."""
    fitted = fit_arima(series, keys, (1, 1, 1), SEASONAL_ORDER, periods, n_test, clip_test=True)
    status = F.when(F.col("n") < 12, "too short").when(F.col("failed"), "failed").otherwise("ok")
    return fitted.withColumn("model", F.lit("SARIMA")).withColumn("status", status)


# MacKinnon's (1994, 2010) response surfaces of the unit-root statistic with constant.
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_TAU = (-18.83, -1.61, 2.74)


def _adf_p(tau: float) -> float:
    least, star, most = ADF_TAU
    if tau > most or tau < least:
        return 1.0 if tau > most else 0.0
    terms = ADF_P_SMALL if tau <= star else ADF_P_LARGE
    return 0.5 * (1 + math.erf(sum(c * tau**i for i, c in enumerate(terms)) / math.sqrt(2)))


def _adf(y: np.ndarray, lags: int | None = None) -> tuple[float, int, int] | None:
    """Statistic, lags used and observations; without ``lags`` those with the least AIC on a common sample."""
    n = len(y)
    change = np.diff(y)
    most = max(min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2), 0)

    def regress(lags: int, drop: int):
        rows = np.arange(drop, len(change))
        x = np.column_stack([np.ones(len(rows)), y[rows], *[change[rows - j] for j in range(1, lags + 1)]])
        beta, _, rank, _ = np.linalg.lstsq(x, change[rows], rcond=None)
        error = change[rows] - x @ beta
        return x, beta, float(error @ error), rank

    def aic(lags: int) -> float:
        x, _, sse, _ = regress(lags, most)
        return len(x) * math.log(max(sse, 1e-300) / len(x)) + 2 * x.shape[1]

    lags = min(range(most + 1), key=aic) if lags is None else min(lags, most)
    x, beta, sse, rank = regress(lags, lags)
    free = len(x) - x.shape[1]
    if rank < x.shape[1] or free <= 0 or sse <= 0:
        return None
    spread = math.sqrt(sse / free * np.linalg.inv(x.T @ x)[1, 1])
    return float(beta[1] / spread), lags, len(x)


def check_stationarity(series: DataFrame, keys: Sequence[str], significance: float = 0.05, lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with constant: statistic, p value, 5 % critical value, verdict.

    ``lags`` fixes the lags of the change; without it they are chosen for each series.
    """

    @fit_udf("adf_statistic double, p_value double, critical_5 double, lags int, message string")
    def test(values: pd.Series) -> pd.DataFrame:
        rows = []
        for y in values:
            y = np.array([v for v in y if v is not None and v == v], dtype=float)
            found = _adf(y, lags) if len(y) >= 10 else None
            if found is None:
                short = "Insufficient data for ADF test" if len(y) < 10 else "No variation"
                rows.append((None, None, None, None, short))
                continue
            tau, chosen, used = found
            p = _adf_p(tau)
            critical = sum(c / used**i for i, c in enumerate(ADF_CRITICAL["5%"]))
            rows.append((tau, p, critical, chosen, "Stationary" if p < significance else "Non-stationary"))
        return pd.DataFrame(rows, columns=["adf_statistic", "p_value", "critical_5", "lags", "message"])

    tested = spread_fits(as_arrays(series, keys), keys).withColumn("_t", test("values"))
    return tested.select(*keys, "n", "_t.*").withColumn("is_stationary", F.col("message") == "Stationary")
