"""Choosing between models, and forecasts of every metric at every level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyworks.functions.lineage import materialise
from tallyworks.operators.forecast import arima, ensemble, structural
from tallyworks.operators.forecast.evaluate import evaluate_forecast, with_position
from tallyworks.operators.forecast.linear import direction, fit_line, forecast_line, line, widening_band
from tallyworks.operators.forecast.scenario import scenario_forecasts
from tallyworks.operators.forecast.smoothing import (
    as_arrays,
    fit_holt,
    fit_winters,
    forecast_winters,
    holt_point,
    residual_spread,
    spread_fits,
    winters_metrics,
)
from tallyworks.operators.panel import prepare_series
from tallyworks.operators.stats import long_form
from tallyworks.functions.columns import explode_future

LINEAR, HOLT = "Linear Trend", "Holt's Linear Trend"
METHODOLOGY = "Linear and damped trends for short-term planning; no season is assumed."

FORECAST_METRICS = ["total_enrolment", "total_updates", "total_demo_updates", "total_bio_updates", "service_workload"]


def metric_series(panel: DataFrame, metrics: Sequence[str] = FORECAST_METRICS, how: str = "sum", by_state: bool = True) -> DataFrame:
    """(level, state, metric, date, value) per month: the nation and every state, in one pass.

    ``how="sum"`` also adds up ratios over the rows of a month; ``mean`` averages them.
    """
    f = F.sum if how == "sum" else F.avg
    rows = long_form(panel.withColumn("date", F.trunc("date", "month")), ["date"] + (["state"] if by_state else []), metrics)
    date, metric = F.col("date"), F.col("metric")
    if not by_state:
        grouped = rows.groupBy(date, metric).agg(f("value").alias("value"))
        return grouped.select(F.lit("National").alias("level"), F.lit("All").alias("state"), "metric", "date", "value")
    state = F.col("state")
    grouped = rows.groupingSets([[date, metric], [date, state, metric]], date, state, metric).agg(
        f("value").alias("value"), F.grouping("state").alias("_all")
    )
    national = F.col("_all") == 1
    return grouped.select(
        F.when(national, "National").otherwise("State").alias("level"),
        F.when(national, "All").otherwise(F.col("state")).alias("state"),
        "metric",
        "date",
        "value",
    )


SERIES_KEYS = ["level", "state", "metric"]


def fit_trends(series: DataFrame, keys: Sequence[str], n_test_months: int | None = 2) -> DataFrame:
    """Linear and Holt fits of every series, without the hold-out and on all points; one row per series.

    The hold-out has ``n_test_months`` points, but no more than a fifth of the series and at
    least one; ``None`` takes the dashboard's choice, a quarter up to two. Fewer than four
    points to train on gives the status ``too short``. The result is a stage table.
    """
    wanted = F.least(F.lit(2), F.floor(F.col("n") / 4)) if n_test_months is None else F.lit(n_test_months)
    n_test = F.least(wanted, F.greatest(F.lit(1), F.floor(F.col("n") / 5))).cast("int")
    rows = with_position(series, keys).withColumn("n_test", n_test)
    trained = F.when(F.col("i") < F.col("n") - F.col("n_test"), F.col("value"))
    slope, intercept = line(F.col("value"), F.col("i"), keys)
    train_slope, train_intercept = line(trained, F.col("i"), keys)
    rows = rows.withColumns(
        {"slope": slope, "intercept": intercept, "train_slope": train_slope, "train_intercept": train_intercept}
    )
    error = F.col("value") - F.col("intercept") - F.col("slope") * F.col("i")
    points = F.sort_array(F.collect_list(F.struct("date", "value")))
    lines = rows.groupBy(*keys).agg(
        F.transform(points, lambda p: p["value"]).alias("values"),
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max("date").alias("last_date"),
        F.stddev_pop(error).alias("sigma"),
        *[F.first(c).alias(c) for c in ("n_test", "slope", "intercept", "train_slope", "train_intercept")],
    )
    lines = lines.withColumn("n_train", F.col("n") - F.col("n_test"))
    usable = F.col("n_train") >= 4
    lines = lines.withColumn("status", F.when(usable, "ok").otherwise("too short"))
    lines = lines.withColumn("train_values", F.slice("values", F.lit(1), F.greatest("n_train", F.lit(0))))
    lines = spread_fits(lines, keys)
    fitted = fit_holt(fit_holt(lines, "train_values", "train_holt"), "values", "holt")
    return materialise(fitted.drop("train_values"), "trend-fits")


def trend_predictions(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model, step, actual, predicted) on the hold-out, never below 0."""
    tested = fits.where("status = 'ok'").select(
        "*", F.posexplode(F.slice("values", F.col("n_train") + 1, F.col("n_test"))).alias("_i", "actual")
    )
    step = F.col("_i") + 1
    linear = F.greatest(F.col("train_intercept") + F.col("train_slope") * (F.col("n_train") + F.col("_i")), F.lit(0.0))
    holt = F.coalesce(F.greatest(holt_point(F.col("train_holt"), step), F.lit(0.0)), linear)
    models = [F.struct(F.lit(m).alias("model"), p.alias("predicted")) for m, p in ((LINEAR, linear), (HOLT, holt))]
    return tested.select(*keys, step.alias("step"), "actual", F.inline(F.array(*models)))


def trend_evaluation(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The model with the lower sMAPE on the hold-out (linear of equals), one row per series."""
    scores = evaluate_forecast(trend_predictions(fits, keys), [*keys, "model"])
    row = F.struct("model", "mae", "smape", "n_test_periods")
    best = scores.groupBy(*keys).agg(F.min_by(row, F.struct("smape", F.col("model") != LINEAR)).alias("_b"))
    facts = fits.select(
        *keys, "n", direction(F.col("slope")).alias("trend_direction"), (F.col("n") >= 12).alias("sarima_ready"), "status"
    )
    return facts.join(best, list(keys), "left").select(
        *keys, "_b.model", "_b.mae", "_b.smape", "_b.n_test_periods", "n", "trend_direction", "sarima_ready", "status"
    )


def trend_forecast(fits: DataFrame, evaluation: DataFrame, keys: Sequence[str], periods: int = 6) -> DataFrame:
    """Forecast of the chosen model, fitted on all points, from the first of next month."""
    chosen = fits.join(evaluation.select(*keys, "model"), list(keys)).where("model IS NOT NULL")
    ahead = explode_future(chosen, "last_date", periods)
    step, n = F.col("step"), F.col("n")
    use_holt = (F.col("model") == HOLT) & F.col("holt").isNotNull()
    raw = F.when(use_holt, holt_point(F.col("holt"), step)).otherwise(F.col("intercept") + F.col("slope") * (n + step - 1))
    sigma = F.when(use_holt, residual_spread(F.col("holt"), n)).otherwise(F.col("sigma"))
    point, lower, upper = widening_band(raw, sigma, step)
    return ahead.select(
        *keys, "model", "step", "date", point.alias("forecast"), lower.alias("lower_ci"), upper.alias("upper_ci")
    )


def trend_pipeline(series: DataFrame, keys: Sequence[str], n_test_months: int | None = 2, periods: int = 6) -> dict[str, DataFrame]:
    """Evaluation, forecast, hold-out predictions and scenarios of all series."""
    fits = fit_trends(series, keys, n_test_months)
    evaluation = trend_evaluation(fits, keys)
    return {
        "evaluation": evaluation,
        "forecast": trend_forecast(fits, evaluation, keys, periods),
        "predictions": trend_predictions(fits, keys),
        "scenarios": scenario_forecasts(series, keys, periods),
    }


def generate_forecasts(
    df: DataFrame, target: str, keys: Sequence[str] = (), periods: int = 12, method: str = "arima", date: str = "date", freq: str = "M"
) -> DataFrame:
    """Series of ``target`` forecast by ``linear``, ``arima`` (order searched) or ``sarima``."""
    if method not in ("linear", "arima", "sarima"):
        raise ValueError(f"Unknown method: {method}")
    if not keys:
        one = df.withColumn("_all", F.lit(target))
        return generate_forecasts(one, target, ["_all"], periods, method, date, freq).drop("_all")
    series = prepare_series(df, target, keys, freq, "sum", date)
    if method == "linear":
        rows = forecast_line(fit_line(series, keys), keys, periods, freq)
    else:
        series = materialise(series, "series")
        if method == "arima":
            fit = arima.fit_best_arima(series, keys, periods)
        else:
            season = arima.SEASONAL_ORDER if freq == "M" else (1, 1, 1, 4)
            fit = arima.fit_arima(series, keys, (1, 1, 1), season, periods)
        rows = arima.arima_forecast(materialise(fit, "fits"), series, keys, periods, method, freq)
    return forecast_table(rows, method, target, keys)


def forecast_table(rows: DataFrame, method: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.select(
        *keys, "step", "date", "forecast", "lower_ci", "upper_ci", F.lit(method).alias("method"), F.lit(target).alias("target")
    )


ENHANCED_METHODS = ("structural", "exponential", "ml_ensemble")


def enhanced_models(
    series: DataFrame, keys: Sequence[str], periods: int = 12, methods: Sequence[str] = ENHANCED_METHODS, **ensemble_options
) -> tuple[DataFrame, DataFrame]:
    """Metrics (keys, method, mae, rmse) and forecasts (keys, method, step, date, ...) of several models."""
    unknown = set(methods) - {*ENHANCED_METHODS, "arima"}
    if unknown:
        raise ValueError(f"Unknown methods: {sorted(unknown)}")
    metrics, forecasts = [], []

    def add(method: str, scores: DataFrame, rows: DataFrame) -> None:
        metrics.append(scores.select(*keys, F.lit(method).alias("method"), "mae", "rmse"))
        forecasts.append(
            rows.select(*keys, F.lit(method).alias("method"), "step", "date", "forecast", "lower_ci", "upper_ci")
        )

    if "structural" in methods:
        fit = materialise(structural.fit_structural(series, keys, periods), "structural")
        add("structural", fit, structural.forecast_structural(fit, keys, periods))
    if "exponential" in methods:
        fit = materialise(fit_winters(spread_fits(as_arrays(series, keys), keys)), "winters").where(F.col("winters").isNotNull())
        mae, rmse = winters_metrics(F.col("winters"), F.col("n"))
        add("exponential", fit.withColumns({"mae": mae, "rmse": rmse}), forecast_winters(fit, keys, periods))
    if "ml_ensemble" in methods:
        add("ml_ensemble", *ensemble.fit_ensemble(series, keys, periods, **ensemble_options))
    if "arima" in methods:
        fit = materialise(arima.fit_arima(series, keys, periods=periods), "arima")
        add("arima", fit.where(~F.col("failed")), arima.arima_forecast(fit, series, keys, periods).where("method = 'arima'"))
    all_metrics, all_forecasts = metrics[0], forecasts[0]
    for m, f in zip(metrics[1:], forecasts[1:]):
        all_metrics, all_forecasts = all_metrics.unionByName(m), all_forecasts.unionByName(f)
    return all_metrics, all_forecasts


def enhanced_forecasts(series: DataFrame, keys: Sequence[str], periods: int = 12, methods: Sequence[str] = ENHANCED_METHODS, **options) -> DataFrame:
    """Forecast of the model with the least MAE per series; the straight line where none could be fitted."""
    keys = list(keys)
    metrics, forecasts = enhanced_models(series, keys, periods, methods, **options)
    best = metrics.groupBy(*keys).agg(F.min_by("method", F.struct("mae", "method")).alias("method"))
    fallback = fit_line(series.join(best.select(*keys), keys, "left_anti"), keys)
    line_rows = forecast_line(fallback, keys, periods).withColumn("method", F.lit("linear"))
    return forecasts.join(best, [*keys, "method"]).unionByName(line_rows)


def performance_table(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hold-out accuracy per series."""
    return fit.select(*keys, "mae", "rmse", "smape", "r2")


def planning_table(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecast rows under planning names."""
    return forecast.select(
        *keys,
        "date",
        F.col("forecast").alias("expected"),
        F.col("lower_ci").alias("conservative_min"),
        F.col("upper_ci").alias("high_demand_max"),
    )
