"""Series models, evaluation and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    FACTS, HEADLINE, SERIES, SERIES_KEYS, joined, monthly, panel, query, series, shown,
)
from tallyworks.functions import arima as arima_fit
from tallyworks.functions.lineage import materialise
from tallyworks.operators.forecast import arima, ensemble, evaluate, linear, scenario, select, smoothing, structural
from tallyworks.plans import pipelines
from tallyworks.sources import order_facts

KEYS = ", ".join(SERIES_KEYS)
BANDS = "forecast lower_ci upper_ci"

INDEXED = joined(
    SERIES,
    f"idx AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {KEYS}) AS n FROM series)",
)


def fitted(source: str, fit: str) -> str:
    """CTEs ``<fit>_line`` and ``<fit>``: the straight line over the rows of ``source``."""
    e = "(value - intercept - slope * i)"
    return joined(
        f"""{fit}_line AS (SELECT {KEYS}, coalesce(regr_slope(value, i), 0) AS slope, coalesce(regr_intercept(value, i), avg(value)) AS intercept,
          count(*) AS n, max(date) AS last_date FROM {source} GROUP BY ALL)""",
        f"""{fit} AS (SELECT {KEYS}, any_value(slope) AS slope, any_value(intercept) AS intercept, any_value(l.n) AS n,
          any_value(last_date) AS last_date, avg(abs({e})) AS mae, sqrt(avg({e} * {e})) AS rmse,
          1 - sum({e} * {e}) / nullif(var_pop(value) * count(*), 0) AS r2, stddev_pop({e}) AS sigma,
          CASE WHEN any_value(slope) > 0 THEN 'Increasing' WHEN any_value(slope) < 0 THEN 'Decreasing' ELSE 'Stable' END AS trend_direction
          FROM {source} JOIN {fit}_line l USING ({KEYS}) GROUP BY {KEYS})""",
    )


LINE = joined(INDEXED, fitted("idx", "fit"))


def steps(n: int) -> str:
    return f"(SELECT unnest(generate_series(1, {n})) AS step)"


MONTH_START = "CAST(date_trunc('month', last_date) + to_months(CAST(step AS INTEGER)) AS DATE)"
POINT = "(intercept + slope * (n + step - 1))"


def trend_sql(fit: str, periods: int) -> str:
    reach = "1.96 * sigma * sqrt(step)"
    return (
        f"SELECT {KEYS}, step, {MONTH_START} AS date, greatest({POINT}, 0) AS forecast, "
        f"greatest(greatest({POINT}, 0) - {reach}, 0) AS lower_ci, greatest({POINT}, 0) + {reach} AS upper_ci FROM {fit} CROSS JOIN {steps(periods)}"
    )


def line_sql(fit: str, periods: int) -> str:
    return (
        f"SELECT {KEYS}, step, last_day({MONTH_START}) AS date, {POINT} AS forecast, "
        f"{POINT} - 1.96 * sigma AS lower_ci, {POINT} + 1.96 * sigma AS upper_ci FROM {fit} CROSS JOIN {steps(periods)}"
    )


# --- straight lines --------------------------------------------------------


@query(
    "fitted_line",
    shown("SELECT * FROM fit", floats="slope intercept mae rmse r2 sigma", whole="n", dates="last_date", ctes=LINE),
)
def _(spark, sf_dir):
    return linear.fit_line(series(spark, sf_dir), SERIES_KEYS)


@query(
    "trend_direction",
    shown(f"SELECT {KEYS}, slope, intercept, trend_direction FROM fit", floats="slope intercept", dates="", ctes=LINE),
)
def _(spark, sf_dir):
    fit = linear.fit_line(series(spark, sf_dir), SERIES_KEYS)
    return fit.select(*SERIES_KEYS, "slope", "intercept", "trend_direction")


@query("line_forecast", shown(line_sql("fit", 6), floats=BANDS, whole="step", ctes=LINE))
def _(spark, sf_dir):
    return linear.forecast_line(linear.fit_line(series(spark, sf_dir), SERIES_KEYS), SERIES_KEYS, 6)


@query("trend_line_forecast", shown(trend_sql("fit", 6), floats=BANDS, whole="step", ctes=LINE))
def _(spark, sf_dir):
    return linear.forecast_trend(linear.fit_line(series(spark, sf_dir), SERIES_KEYS), SERIES_KEYS, 6)


@query(
    "clipped_forecast",
    shown(
        f"SELECT {KEYS}, step, greatest({POINT} - 400, 0) AS forecast, greatest({POINT}, 0) AS unshifted FROM fit CROSS JOIN {steps(12)}",
        floats="forecast unshifted", whole="step", dates="", ctes=LINE,
    ),
)
def _(spark, sf_dir):
    fit = linear.fit_line(series(spark, sf_dir), SERIES_KEYS)
    lowered = linear.forecast_trend(fit.withColumn("intercept", F.col("intercept") - 400), SERIES_KEYS, 12)
    plain = linear.forecast_trend(fit, SERIES_KEYS, 12).select(*SERIES_KEYS, "step", F.col("forecast").alias("unshifted"))
    return lowered.select(*SERIES_KEYS, "step", "forecast").join(plain, [*SERIES_KEYS, "step"])


# --- splits and evaluation -------------------------------------------------


def _split_sql(n_train: str) -> str:
    return shown(
        f"SELECT {KEYS}, date, value, CASE WHEN i < {n_train} THEN 'train' ELSE 'test' END AS split FROM idx",
        floats="value", ctes=INDEXED,
    )


@query("split_last_six", _split_sql("(CASE WHEN n <= 6 THEN floor(n * 0.8) ELSE n - 6 END)"))
def _(spark, sf_dir):
    return evaluate.split_last(series(spark, sf_dir), SERIES_KEYS, 6)


@query("split_last_hundred", _split_sql("floor(n * 0.8)"))
def _(spark, sf_dir):
    return evaluate.split_last(series(spark, sf_dir), SERIES_KEYS, 100)


@query("split_by_ratio", _split_sql("(n - greatest(1, floor(n * 0.2)))"))
def _(spark, sf_dir):
    return evaluate.split_ratio(series(spark, sf_dir), SERIES_KEYS, 0.2)


HOLDOUT = joined(
    INDEXED,
    fitted("(SELECT * FROM idx WHERE i < n - 6)", "train"),
    f"""aligned AS (SELECT {KEYS}, i - (idx.n - 6) + 1 AS step, value AS actual, greatest(intercept + slope * i, 0) AS predicted
      FROM idx JOIN train USING ({KEYS}) WHERE i >= idx.n - 6)""",
)


def holdout(spark, sf_dir):
    """Test points of every series next to the line fitted without them."""
    rows = materialise(evaluate.with_position(series(spark, sf_dir), SERIES_KEYS))
    split = F.col("i") - (F.col("n") - 6)
    train = rows.where(split < 0).drop("i", "n")
    test = rows.where(split >= 0).select(*SERIES_KEYS, (split + 1).alias("step"), F.col("value").alias("actual"))
    ahead = linear.forecast_trend(linear.fit_line(train, SERIES_KEYS), SERIES_KEYS, 6)
    return evaluate.align(test, ahead.withColumnRenamed("forecast", "predicted"), SERIES_KEYS)


@query("holdout_alignment", shown("SELECT * FROM aligned", floats="actual predicted", whole="step", dates="", ctes=HOLDOUT))
def _(spark, sf_dir):
    return holdout(spark, sf_dir)


SMAPE = "coalesce(avg(CASE WHEN abs(actual) + abs(predicted) > 2e-10 THEN 200 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END), 0)"


@query(
    "forecast_errors",
    shown(f"SELECT {KEYS}, {SMAPE} AS smape, avg(abs(actual - predicted)) AS mae FROM aligned GROUP BY ALL", floats="smape mae", dates="", ctes=HOLDOUT),
)
def _(spark, sf_dir):
    rows = holdout(spark, sf_dir)
    return rows.groupBy(*SERIES_KEYS).agg(
        evaluate.smape("actual", "predicted").alias("smape"), evaluate.mae("actual", "predicted").alias("mae")
    )


@query(
    "forecast_evaluation",
    shown(
        f"SELECT {KEYS}, 'Linear Trend' AS model, {SMAPE} AS smape, avg(abs(actual - predicted)) AS mae, count(*) AS n_test_periods FROM aligned GROUP BY ALL",
        floats="smape mae", whole="n_test_periods", dates="", ctes=HOLDOUT,
    ),
)
def _(spark, sf_dir):
    rows = holdout(spark, sf_dir).withColumn("model", F.lit("Linear Trend"))
    return evaluate.evaluate_forecast(rows, [*SERIES_KEYS, "model"])


@query(
    "forecast_accuracy",
    shown(
        f"""SELECT {KEYS}, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
        avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS mape,
        CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))
          WHEN sum((actual - predicted) ** 2) > 0 THEN 0 ELSE 1 END AS r2 FROM aligned GROUP BY ALL""",
        floats="mae rmse mape r2", dates="", ctes=HOLDOUT,
    ),
)
def _(spark, sf_dir):
    return evaluate.forecast_accuracy(holdout(spark, sf_dir), SERIES_KEYS)


# --- features --------------------------------------------------------------


def _lags(frame: str) -> str:
    w = f"(PARTITION BY {KEYS} ORDER BY date"
    return shown(
        f"""SELECT {KEYS}, date, value, lag_1, lag_2, lag_3, rolling_mean_3, rolling_std_3, month(date) AS month, quarter(date) AS quarter FROM (
        SELECT *, lag(value, 1) OVER {w}) AS lag_1, lag(value, 2) OVER {w}) AS lag_2, lag(value, 3) OVER {w}) AS lag_3,
          avg(value) OVER {w} ROWS BETWEEN {frame}) AS rolling_mean_3, stddev_samp(value) OVER {w} ROWS BETWEEN {frame}) AS rolling_std_3
        FROM series) WHERE lag_3 IS NOT NULL""",
        floats="value lag_1 lag_2 lag_3 rolling_mean_3 rolling_std_3", whole="month quarter", ctes=SERIES,
    )


@query("lag_features", _lags("3 PRECEDING AND 1 PRECEDING"))
def _(spark, sf_dir):
    return ensemble.lag_features(series(spark, sf_dir), SERIES_KEYS)


@query("lag_features_with_current", _lags("2 PRECEDING AND CURRENT ROW"))
def _(spark, sf_dir):
    return ensemble.lag_features(series(spark, sf_dir), SERIES_KEYS, include_current=True)


# --- scenarios -------------------------------------------------------------

SCENARIO = joined(
    SERIES,
    f"""ends AS (SELECT {KEYS}, first(value ORDER BY date) AS first_value, last(value ORDER BY date) AS last_value, count(*) AS n,
      max(date) AS last_date FROM series GROUP BY ALL)""",
    f"""scenarios AS (SELECT {KEYS}, scenario, step, {MONTH_START} AS date,
      greatest(last_value + (last_value - first_value) / n * g * step, 0) * f AS forecast FROM ends CROSS JOIN {steps(6)}
      CROSS JOIN (VALUES ('Expected', 1.0::DOUBLE, 1.0::DOUBLE), ('Optimistic', 1.2::DOUBLE, 1.0::DOUBLE), ('Conservative', 1.0::DOUBLE, 0.9::DOUBLE)) AS v(scenario, g, f))""",
)


@query("scenario_forecasts", shown("SELECT * FROM scenarios", floats="forecast", whole="step", ctes=SCENARIO))
def _(spark, sf_dir):
    return scenario.scenario_forecasts(series(spark, sf_dir), SERIES_KEYS, 6)


@query(
    "scenario_means",
    shown(f"SELECT {KEYS}, scenario, avg(forecast) AS mean_forecast FROM scenarios GROUP BY ALL", floats="mean_forecast", dates="", ctes=SCENARIO),
)
def _(spark, sf_dir):
    return scenario.scenario_means(scenario.scenario_forecasts(series(spark, sf_dir), SERIES_KEYS, 6), SERIES_KEYS)


@query(
    "bound_summary",
    shown(
        f"""SELECT {KEYS}, scenario, avg(value) AS average, sum(value) AS total FROM (
        SELECT {KEYS}, 'Conservative' AS scenario, lower_ci AS value FROM ahead UNION ALL SELECT {KEYS}, 'Expected', forecast FROM ahead
        UNION ALL SELECT {KEYS}, 'High Demand', upper_ci FROM ahead) GROUP BY ALL""",
        floats="average total", dates="", ctes=joined(LINE, f"ahead AS ({trend_sql('fit', 12)})"),
    ),
)
def _(spark, sf_dir):
    ahead = linear.forecast_trend(linear.fit_line(series(spark, sf_dir), SERIES_KEYS), SERIES_KEYS, 12)
    return scenario.bound_summary(ahead, SERIES_KEYS)


# --- generated forecasts ---------------------------------------------------

GENERATED = joined(
    FACTS, monthly("state"),
    """series AS (SELECT 'State' AS level, state, 'age_0_5' AS metric, last_day(date) AS date, CAST(age_0_5 AS DOUBLE) AS value FROM merged)""",
    f"idx AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {KEYS}) AS n FROM series)",
    fitted("idx", "fit"),
)


@query(
    "generated_linear_forecast",
    shown(f"SELECT * EXCLUDE (level, metric), 'linear' AS method, 'age_0_5' AS target FROM ({line_sql('fit', 12)})", floats=BANDS, whole="step", ctes=GENERATED),
)
def _(spark, sf_dir):
    merged = pipelines.monthly_panel(order_facts.activity(spark, sf_dir))
    return select.generate_forecasts(merged, "age_0_5", ["state"], 12, "linear")


@query("generated_arima_forecast")
def _(spark, sf_dir):
    return select.generate_forecasts(panel(spark, sf_dir), "total_updates", [], 12, "arima")


@query("generated_sarima_forecast")
def _(spark, sf_dir):
    return select.generate_forecasts(panel(spark, sf_dir), "total_updates", ["state"], 12, "sarima")


# --- trend pipeline --------------------------------------------------------


def _headline_series(spark, sf_dir):
    return materialise(select.metric_series(panel(spark, sf_dir), HEADLINE), "series")


@query("holt_fit")
def _(spark, sf_dir):
    arrays = smoothing.spread_fits(smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS), SERIES_KEYS)
    state = [F.col("holt")[c].alias(f"holt_{c}") for c in ("alpha", "beta", "phi", "level", "trend", "sse")]
    return smoothing.fit_holt(arrays).select(*SERIES_KEYS, "n", *state)


@query("holt_forecast")
def _(spark, sf_dir):
    arrays = smoothing.spread_fits(smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS), SERIES_KEYS)
    return smoothing.forecast_holt(smoothing.fit_holt(arrays), SERIES_KEYS, 6)


# Smoothing with given weights, a point at a time: the start without an error, then level and trend moved by each error.
_SEEN = f"seen AS (SELECT {KEYS}, CAST(i AS INT) AS i, n, date, CAST(value AS DOUBLE) AS value, CAST(lead(value) OVER (PARTITION BY {KEYS} ORDER BY i) AS DOUBLE) AS next FROM idx)"
_OFF = "(seen.value - run.l - 0.9 * run.b)"
HOLT = joined(
    "RECURSIVE " + INDEXED,
    _SEEN,
    f"""run AS (SELECT {KEYS}, i, n, date, value AS l, next - value AS b, 0::DOUBLE AS se, 0::DOUBLE AS sse FROM seen WHERE i = 0 AND n > 1
      UNION ALL SELECT {KEYS}, seen.i, seen.n, seen.date, run.l + 0.9 * run.b + 0.4 * {_OFF}, 0.9 * run.b + 0.04 * {_OFF}, run.se + {_OFF}, run.sse + {_OFF} ** 2
      FROM run JOIN seen USING ({KEYS}) WHERE seen.i = run.i + 1)""",
    "held AS (SELECT *, sqrt(greatest(sse / n - (se / n) ** 2, 0)) AS sigma FROM run WHERE i = n - 1)",
)
HOLT_WEIGHTS = (0.4, 0.1, 0.9)


@query(
    "holt_given_weights",
    shown(f"SELECT {KEYS}, n, l AS holt_level, b AS holt_trend, sse, se FROM held", floats="holt_level holt_trend sse se", whole="n", dates="", ctes=HOLT),
)
def _(spark, sf_dir):
    fit = smoothing.fit_holt(smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS), weights=HOLT_WEIGHTS).where("holt IS NOT NULL")
    state = {"level": "holt_level", "trend": "holt_trend", "sse": "sse", "se": "se"}
    return fit.select(*SERIES_KEYS, "n", *[F.col("holt")[c].alias(name) for c, name in state.items()])


@query(
    "holt_forecast_given_weights",
    shown(
        f"""SELECT {KEYS}, step, CAST(date_trunc('month', date) + to_months(CAST(step AS INTEGER)) AS DATE) AS date, greatest(said, 0) AS forecast,
          greatest(greatest(said, 0) - {linear.Z95} * sigma * sqrt(step), 0) AS lower_ci, greatest(said, 0) + {linear.Z95} * sigma * sqrt(step) AS upper_ci
          FROM (SELECT *, l + b * 0.9 * (1 - 0.9 ** step) / 0.1 AS said FROM held, generate_series(1, 6) AS g(step))""",
        floats="forecast lower_ci upper_ci", whole="step", ctes=HOLT,
    ),
)
def _(spark, sf_dir):
    arrays = smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS)
    return smoothing.forecast_holt(smoothing.fit_holt(arrays, weights=HOLT_WEIGHTS), SERIES_KEYS, 6)


# The season is a list that each point changes one entry of.
_GONE = "(seen.value - run.l - run.b - run.s[seen.i % 12 + 1])"
WINTERS = joined(
    "RECURSIVE " + INDEXED,
    _SEEN,
    f"""years AS (SELECT {KEYS}, n, avg(value) FILTER (i < 12) AS first, avg(value) FILTER (i BETWEEN 12 AND 23) AS second,
      list(value ORDER BY i) FILTER (i < 12) AS head FROM seen GROUP BY {KEYS}, n HAVING n >= 24)""",
    f"""run AS (SELECT {KEYS}, -1 AS i, n, NULL::DATE AS date, first AS l, (second - first) / 12 AS b, list_transform(head, lambda x: x - first) AS s,
        0::DOUBLE AS se, 0::DOUBLE AS sae, 0::DOUBLE AS sse FROM years
      UNION ALL SELECT {KEYS}, seen.i, seen.n, seen.date, run.l + run.b + 0.3 * {_GONE}, run.b + 0.03 * {_GONE},
        list_transform(run.s, lambda x, k: CASE WHEN k = seen.i % 12 + 1 THEN x + 0.2 * {_GONE} ELSE x END), run.se + {_GONE}, run.sae + abs({_GONE}), run.sse + {_GONE} ** 2
      FROM run JOIN seen USING ({KEYS}) WHERE seen.i = run.i + 1)""",
    "held AS (SELECT *, sqrt(greatest(sse / n - (se / n) ** 2, 0)) AS sigma FROM run WHERE i = n - 1)",
)
WINTERS_WEIGHTS = (0.3, 0.1, 0.2)


@query(
    "winters_forecast_given_weights",
    shown(
        f"""SELECT {KEYS}, step, last_day(date + to_months(CAST(step AS INTEGER))) AS date, said AS forecast,
          said - {linear.Z95} * sigma AS lower_ci, said + {linear.Z95} * sigma AS upper_ci
          FROM (SELECT *, l + b * step + s[(n + step - 1) % 12 + 1] AS said FROM held, generate_series(1, 14) AS g(step))""",
        floats="forecast lower_ci upper_ci", whole="step", ctes=WINTERS,
    ),
)
def _(spark, sf_dir):
    fit = smoothing.fit_winters(smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS), weights=WINTERS_WEIGHTS)
    return smoothing.forecast_winters(fit, SERIES_KEYS, 14)


@query(
    "winters_metrics_given_weights",
    shown(f"SELECT {KEYS}, sae / n AS mae, sqrt(sse / n) AS rmse FROM held", floats="mae rmse", dates="", ctes=WINTERS),
)
def _(spark, sf_dir):
    fit = smoothing.fit_winters(smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS), weights=WINTERS_WEIGHTS).where("winters IS NOT NULL")
    mae, rmse = smoothing.winters_metrics(F.col("winters"), F.col("n"))
    return fit.select(*SERIES_KEYS, mae.alias("mae"), rmse.alias("rmse"))


@query("trend_evaluation")
def _(spark, sf_dir):
    fits = select.fit_trends(series(spark, sf_dir), SERIES_KEYS)
    return scenario.with_accuracy(select.trend_evaluation(fits, SERIES_KEYS))


@query("trend_forecast")
def _(spark, sf_dir):
    fits = select.fit_trends(series(spark, sf_dir), SERIES_KEYS)
    return select.trend_forecast(fits, select.trend_evaluation(fits, SERIES_KEYS), SERIES_KEYS, 6)


@query(
    "trend_linear_predictions",
    shown(
        f"SELECT {KEYS}, 'Linear Trend' AS model, i - (idx.n - 2) + 1 AS step, value AS actual, greatest(intercept + slope * i, 0) AS predicted "
        f"FROM idx JOIN train USING ({KEYS}) WHERE i >= idx.n - 2",
        floats="actual predicted", whole="step", dates="", ctes=joined(INDEXED, fitted("(SELECT * FROM idx WHERE i < n - 2)", "train")),
    ),
)
def _(spark, sf_dir):
    fits = select.fit_trends(series(spark, sf_dir), SERIES_KEYS)
    return select.trend_predictions(fits, SERIES_KEYS).where(F.col("model") == select.LINEAR)


@query("forecasts_at_all_levels")
def _(spark, sf_dir):
    fits = select.fit_trends(series(spark, sf_dir), SERIES_KEYS, n_test_months=None)
    return select.trend_forecast(fits, select.trend_evaluation(fits, SERIES_KEYS), SERIES_KEYS, 6)


# --- other models ----------------------------------------------------------


# Of order (0, d, 0) the models are closed forms: what lies ahead, and the mean square of what is left. AIC values
# of all orders speak of the points after the first two.
_OF = "OVER (PARTITION BY level, state, metric ORDER BY i)"
WALK = joined(
    INDEXED,
    f"""walked AS (SELECT *, value - lag(value) {_OF} AS move, value - 2 * lag(value) {_OF} + lag(value, 2) {_OF} AS bend FROM idx)""",
    f"""walk AS (SELECT {KEYS}, any_value(n) AS n, max(date) AS last_date, arg_max(value, i) AS last, sqrt(greatest(avg(move * move), 1e-12)) AS sigma
      FROM walked GROUP BY {KEYS})""",
)


@query(
    "random_walk_forecast",
    shown(
        f"""SELECT {KEYS}, h AS step, last_day(last_date + to_months(CAST(h AS INTEGER))) AS date, 'walk' AS method, greatest(last, 0) AS forecast,
          greatest(last - {arima_fit.Z95} * sigma * sqrt(h), 0) AS lower_ci, greatest(last + {arima_fit.Z95} * sigma * sqrt(h), 0) AS upper_ci
          FROM walk, generate_series(1, 12) AS g(h)""",
        floats="forecast lower_ci upper_ci", whole="step", ctes=WALK,
    ),
)
def _(spark, sf_dir):
    rows = series(spark, sf_dir)
    fit = arima.fit_arima(rows, SERIES_KEYS, (0, 1, 0))
    return arima.arima_forecast(fit, rows, SERIES_KEYS, 12, "walk")


@query(
    "random_walk_metrics",
    shown(
        f"""SELECT {KEYS}, avg(abs(value - said)) AS mae, sqrt(avg((value - said) ** 2)) AS rmse,
          coalesce(avg(abs(value - said) / ((abs(value) + abs(said)) / 2)) FILTER ((abs(value) + abs(said)) / 2 > 1e-10), 0) * 100 AS smape,
          CASE WHEN var_pop(value) > 0 THEN 1 - avg((value - said) ** 2) / var_pop(value) ELSE 0 END AS r2
          FROM (SELECT *, arg_max(value, i) FILTER (i < n - 6) OVER (PARTITION BY {KEYS}) AS said FROM idx) WHERE i >= n - 6 GROUP BY {KEYS}""",
        floats="mae rmse smape r2", dates="", ctes=WALK,
    ),
)
def _(spark, sf_dir):
    return select.performance_table(arima.fit_arima(series(spark, sf_dir), SERIES_KEYS, (0, 1, 0)), SERIES_KEYS)


_AIC = "{n} * (ln(2 * pi() * greatest({v}, 1e-12)) + 1) + 2 * {k}"
_ORDERS = f"""orders AS (SELECT {KEYS}, 0 AS p, 0 AS d, 0 AS q, {_AIC.format(n="count(*)", v="var_pop(value)", k=2)} AS aic FROM walked WHERE i >= 2 GROUP BY {KEYS}
  UNION ALL SELECT {KEYS}, 0, 1, 0, {_AIC.format(n="count(move)", v="avg(move * move)", k=1)} FROM walked WHERE i >= 2 GROUP BY {KEYS}
  UNION ALL SELECT {KEYS}, 0, 2, 0, {_AIC.format(n="count(bend)", v="avg(bend * bend)", k=1)} FROM walked WHERE i >= 2 GROUP BY {KEYS})"""


@query("order_search_by_difference", shown("SELECT * FROM orders", floats="aic", whole="p d q", dates="", ctes=joined(WALK, _ORDERS)))
def _(spark, sf_dir):
    return arima.order_search(series(spark, sf_dir), SERIES_KEYS, max_p=0, max_d=2, max_q=0)


@query(
    "best_order_by_difference",
    shown(f"SELECT {KEYS}, arg_min(d, aic) AS d, min(aic) AS aic FROM orders GROUP BY {KEYS}", floats="aic", whole="d", dates="", ctes=joined(WALK, _ORDERS)),
)
def _(spark, sf_dir):
    best = arima.best_order(arima.order_search(series(spark, sf_dir), SERIES_KEYS, max_p=0, max_d=2, max_q=0), SERIES_KEYS)
    return best.select(*SERIES_KEYS, F.col("order")[1].alias("d"), "aic")


# Of a first-order autoregression the exact likelihood is a closed form: the first point, then each given the one before.
_AR = "(value - 1000 - 0.5 * (before - 1000))"
AR = joined(
    INDEXED,
    f"chained AS (SELECT *, lag(value) {_OF} AS before FROM idx)",
    f"""judged AS (SELECT {KEYS}, n, greatest((sum((value - 1000) ** 2) FILTER (i = 0) * 0.75 + coalesce(sum({_AR} ** 2) FILTER (i > 0), 0)) / n, 1e-12) AS sigma2 FROM chained GROUP BY {KEYS}, n)""",
)


@query(
    "arima_likelihood",
    shown(
        f"""SELECT *, 6 - 2 * loglik AS aic FROM (SELECT {KEYS}, n, sigma2, -0.5 * (n * (ln(2 * pi() * sigma2) + 1) - ln(0.75)) AS loglik FROM judged)""",
        floats="sigma2 loglik aic", whole="n", dates="", ctes=AR,
    ),
)
def _(spark, sf_dir):
    return arima.likelihood(series(spark, sf_dir), SERIES_KEYS, (1, 0, 0), [0.5, 1000.0])


# A walk by seasons, order (0, 0, 0)(0, 1, 0, 12): next year is like this one.
SEASON_WALK = ((0, 0, 0), (0, 1, 0, 12))
SEASONS = joined(
    INDEXED,
    f"""stepped AS (SELECT *, value - lag(value, 12) {_OF} AS move FROM idx)""",
    f"""season_walk AS (SELECT {KEYS}, any_value(n) AS n, max(date) AS last_date, sqrt(greatest(avg(move * move), 1e-12)) AS sigma,
      list(value ORDER BY i DESC) AS back FROM stepped GROUP BY {KEYS} HAVING count(*) >= 20)""",
)


def _long_series(spark, sf_dir):
    rows = series(spark, sf_dir)
    return rows.join(rows.groupBy(*SERIES_KEYS).count().where("count >= 20").select(*SERIES_KEYS), SERIES_KEYS)


@query(
    "seasonal_walk_planning_table",
    shown(
        f"""SELECT {KEYS}, last_day(last_date + to_months(CAST(h AS INTEGER))) AS date, greatest(back[13 - h], 0) AS expected,
          greatest(back[13 - h] - {arima_fit.Z95} * sigma, 0) AS conservative_min, greatest(back[13 - h] + {arima_fit.Z95} * sigma, 0) AS high_demand_max
          FROM season_walk, generate_series(1, 12) AS g(h)""",
        floats="expected conservative_min high_demand_max", ctes=SEASONS,
    ),
)
def _(spark, sf_dir):
    rows = _long_series(spark, sf_dir)
    fit = arima.fit_arima(rows, SERIES_KEYS, *SEASON_WALK)
    return select.planning_table(arima.arima_forecast(fit, rows, SERIES_KEYS, 12, "walk"), SERIES_KEYS)


@query(
    "seasonal_walk_performance",
    shown(
        f"""SELECT {KEYS}, avg(abs(value - said)) AS mae, sqrt(avg((value - said) ** 2)) AS rmse,
          coalesce(avg(abs(value - said) / ((abs(value) + abs(said)) / 2)) FILTER ((abs(value) + abs(said)) / 2 > 1e-10), 0) * 100 AS smape,
          CASE WHEN var_pop(value) > 0 THEN 1 - avg((value - said) ** 2) / var_pop(value) ELSE 0 END AS r2
          FROM (SELECT *, value - move AS said FROM stepped WHERE n >= 20) WHERE i >= n - 6 GROUP BY {KEYS}""",
        floats="mae rmse smape r2", dates="", ctes=SEASONS,
    ),
)
def _(spark, sf_dir):
    return select.performance_table(arima.fit_arima(_long_series(spark, sf_dir), SERIES_KEYS, *SEASON_WALK), SERIES_KEYS)


@query(
    "seasonal_walk_fitted_values",
    shown(f"SELECT {KEYS}, CAST(i AS BIGINT) AS i, value - move AS fitted FROM stepped WHERE n >= 20", floats="fitted", whole="i", dates="", ctes=SEASONS),
)
def _(spark, sf_dir):
    fit = arima.fit_arima(_long_series(spark, sf_dir), SERIES_KEYS, *SEASON_WALK)
    return fit.select(*SERIES_KEYS, F.posexplode("fitted").alias("i", "fitted"))


@query("arima_fit")
def _(spark, sf_dir):
    fit = arima.fit_arima(_headline_series(spark, sf_dir), SERIES_KEYS)
    return fit.select(*SERIES_KEYS, "n", "last_date", "failed", "mae", "rmse", "smape", "r2", "n_test")


@query("arima_order_search")
def _(spark, sf_dir):
    search = arima.order_search(_headline_series(spark, sf_dir), SERIES_KEYS)
    best = arima.best_order(search, SERIES_KEYS)
    return best.withColumn("order", F.array_join(F.col("order").cast("array<string>"), ","))


@query("sarima_pipeline")
def _(spark, sf_dir):
    fit = arima.sarima_pipeline(_headline_series(spark, sf_dir), SERIES_KEYS)
    return select.performance_table(fit, [*SERIES_KEYS, "model", "status"])


@query("sarima_performance")
def _(spark, sf_dir):
    fit = arima.fit_best_arima(_headline_series(spark, sf_dir), SERIES_KEYS, seasonal=arima.SEASONAL_ORDER)
    return select.performance_table(fit, SERIES_KEYS)


@query("sarima_planning_table")
def _(spark, sf_dir):
    rows = _headline_series(spark, sf_dir)
    fit = materialise(arima.fit_best_arima(rows, SERIES_KEYS, seasonal=arima.SEASONAL_ORDER), "sarima")
    return select.planning_table(arima.arima_forecast(fit, rows, SERIES_KEYS, 12, "sarima"), SERIES_KEYS)


# Without lags the test is the slope of the change on the value before, over its standard error.
ADF = joined(
    INDEXED,
    f"""changed AS (SELECT *, lag(value) {_OF} AS before, value - lag(value) {_OF} AS change FROM idx)""",
    f"""tested AS (SELECT {KEYS}, any_value(n) AS n, regr_slope(change, before) / sqrt(regr_syy(change, before) * (1 - regr_r2(change, before)) / (count(change) - 2) / regr_sxx(change, before)) AS tau,
      count(change) AS used FROM changed GROUP BY {KEYS} HAVING count(*) >= 10)""",
)
_C5 = arima.ADF_CRITICAL["5%"]


@query(
    "stationarity_without_lags",
    shown(
        f"""SELECT {KEYS}, n, tau AS adf_statistic, {_C5[0]} + {_C5[1]} / used + {_C5[2]} / used ** 2 + {_C5[3]} / used ** 3 AS critical_5 FROM tested""",
        floats="adf_statistic critical_5", whole="n", dates="", ctes=ADF,
    ),
)
def _(spark, sf_dir):
    found = arima.check_stationarity(series(spark, sf_dir), SERIES_KEYS, lags=0).where("n >= 10")
    return found.select(*SERIES_KEYS, "n", "adf_statistic", "critical_5")


@query("stationarity")
def _(spark, sf_dir):
    return arima.check_stationarity(series(spark, sf_dir), SERIES_KEYS)


@query("winters_forecast")
def _(spark, sf_dir):
    arrays = smoothing.spread_fits(smoothing.as_arrays(series(spark, sf_dir), SERIES_KEYS), SERIES_KEYS)
    return smoothing.forecast_winters(smoothing.fit_winters(arrays), SERIES_KEYS, 6)


@query("structural_forecast")
def _(spark, sf_dir):
    fit = structural.fit_structural(series(spark, sf_dir), SERIES_KEYS, 6)
    return structural.forecast_structural(fit, SERIES_KEYS, 6)


@query("tree_ensemble_forecast")
def _(spark, sf_dir):
    return ensemble.fit_ensemble(_headline_series(spark, sf_dir), SERIES_KEYS, 6)[1]


@query("best_enhanced_forecast")
def _(spark, sf_dir):
    return select.enhanced_forecasts(_headline_series(spark, sf_dir), SERIES_KEYS, 12)
