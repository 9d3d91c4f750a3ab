"""Hold-out splits and accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.columns import col


def smape(actual: Column | str, forecast: Column | str) -> Column:
    """Symmetric percentage error (0 to 200) as an aggregate; pairs of zeros do not count."""
    a, f = col(actual), col(forecast)
    size = F.abs(a) + F.abs(f)
    return F.coalesce(F.avg(F.when(size > 2e-10, 200 * F.abs(a - f) / size)), F.lit(0.0))


def mae(actual: Column | str, forecast: Column | str) -> Column:
    return F.avg(F.abs(col(actual) - col(forecast)))


def r_squared(actual: Column | str, forecast: Column | str, flat: Column | float | None = None) -> Column:
    """Share of variance explained, as an aggregate; ``flat`` where the actual values do not vary."""
    a, f = col(actual), col(forecast)
    total = F.var_pop(a) * F.count(a)
    return F.when(total > 0, 1 - F.try_divide(F.sum((a - f) * (a - f)), total)).otherwise(flat)


def evaluate_forecast(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(keys, mae, smape, n_test_periods); put ``model`` among the keys to compare models."""
    return df.groupBy(*keys).agg(
        mae(actual, predicted).alias("mae"),
        smape(actual, predicted).alias("smape"),
        F.count(actual).alias("n_test_periods"),
    )


def forecast_accuracy(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, MAPE (pairs with actual 0 do not count) and R squared."""
    error = F.col(actual) - F.col(predicted)
    sse = F.sum(error * error)
    return df.groupBy(*keys).agg(
        mae(actual, predicted).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, F.col(actual)))) * 100).alias("mape"),
        r_squared(actual, predicted, flat=F.when(sse > 0, 0.0).otherwise(1.0)).alias("r2"),
    )


def with_position(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the position ``i`` (from 0) of each point and the length ``n`` of its series."""
    w = Window.partitionBy(*keys)
    return series.withColumn("i", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def _split(series: DataFrame, keys: Sequence[str], n_train: Column) -> DataFrame:
    label = F.when(F.col("i") < n_train, "train").otherwise("test")
    return with_position(series, keys).withColumn("split", label).drop("i", "n")


def split_last(series: DataFrame, keys: Sequence[str], test_size: int = 6) -> DataFrame:
    """``split``: the last ``test_size`` points are the test; a series no longer than that is split 80/20."""
    short = F.floor(F.col("n") * 0.8)
    return _split(series, keys, F.when(F.col("n") <= test_size, short).otherwise(F.col("n") - test_size))


def split_ratio(series: DataFrame, keys: Sequence[str], test_ratio: float = 0.2) -> DataFrame:
    """``split``: the last share is the test, at least one point, leaving at least four to train on."""
    n_train = F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * test_ratio))
    return _split(series, keys, F.when(n_train < 4, F.greatest(F.lit(4), F.col("n") - 1)).otherwise(n_train))


def align(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test points next to their predictions, by series and step."""
    return actual.select(*keys, "step", "actual").join(predicted.select(*keys, "step", "predicted"), [*keys, "step"])
