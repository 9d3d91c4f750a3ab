"""Selections on the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.operators.stats import with_group_stats

ALL = "All"


def filter_data(df: DataFrame, date_range=None, state: str = ALL, district: str = ALL) -> DataFrame:
    """Rows of a date pair (inclusive), state and district; ``All`` does not filter.

    Apply it after the indicators: growth and z-scores depend on rows outside the selection.
    """
    if date_range and len(date_range) == 2:
        first, last = (F.lit(str(d)).cast("date") for d in date_range)
        df = df.where(F.col("date").between(first, last))
    if state != ALL:
        df = df.where(F.col("state") == state)
    if district != ALL:
        df = df.where(F.col("district") == district)
    return df


def above_threshold(df: DataFrame, zscore: str, threshold: float = 3.0) -> DataFrame:
    return df.where(F.abs(zscore) > threshold)


def any_flag(*names: str) -> Column:
    """True where one of the flags is set; an unknown flag is not set."""
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(n), F.lit(False))
    return out


def history_status(df: DataFrame, keys, least_trend: int = 5, least_seasonal: int = 12) -> DataFrame:
    """Add the length of each series (``n_months``) and what it suffices for (``status``)."""
    counted = with_group_stats(df, keys, {"n_months": F.count(F.lit(1))})
    status = F.when(F.col("n_months") < least_trend, "too short")
    status = status.when(F.col("n_months") < least_seasonal, "trend only").otherwise("seasonal")
    return counted.withColumn("status", status)


def filter_choices(df: DataFrame, state: str = ALL) -> DataFrame:
    """What a viewer can choose from, as (kind, choice): date bounds, states, districts of the state."""
    dates = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.inline(
            F.array(
                F.struct(F.lit("first_date").alias("kind"), F.col("lo").cast("string").alias("choice")),
                F.struct(F.lit("last_date").alias("kind"), F.col("hi").cast("string").alias("choice")),
            )
        )
    )
    states = df.select(F.lit("state").alias("kind"), F.col("state").alias("choice"))
    districts = filter_data(df, state=state).select(F.lit("district").alias("kind"), F.col("district").alias("choice"))
    return dates.unionByName(states.unionByName(districts).distinct())
