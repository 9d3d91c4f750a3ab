"""Ratio, share, growth and coverage indicators on the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.columns import (
    above,
    bucket,
    growth_percent,
    safe_divide,
    sum_skipping_nulls,
    sum_with_nulls,
)
from tallyworks.functions.lineage import materialise
from tallyworks.schemas import MEASURES

# Upper edges of the workload classes.
WORKLOAD_EDGES = [(1.0, "Low"), (2.0, "Normal"), (5.0, "High")]

GROWTH_METRICS = ("total_enrolment", "total_updates")


def _total(df: DataFrame, fact: str, skip_nulls: bool) -> Column:
    names = [m for m in MEASURES[fact] if m in df.columns]
    if not names:
        return F.lit(0)
    return sum_skipping_nulls(names) if skip_nulls else sum_with_nulls(names)


def total_enrolment(df: DataFrame, skip_nulls: bool = True) -> DataFrame:
    """All age bands together; ``skip_nulls=False`` lets an unknown band make the total unknown."""
    return df.withColumn("total_enrolment", _total(df, "enrolment", skip_nulls))


def total_demographic_updates(df: DataFrame, skip_nulls: bool = True) -> DataFrame:
    return df.withColumn("total_demo_updates", _total(df, "demographic", skip_nulls))


def total_biometric_updates(df: DataFrame, skip_nulls: bool = True) -> DataFrame:
    return df.withColumn("total_bio_updates", _total(df, "biometric", skip_nulls))


def total_updates(df: DataFrame, skip_nulls: bool = True) -> DataFrame:
    """Demographic, biometric and all updates."""
    df = total_biometric_updates(total_demographic_updates(df, skip_nulls), skip_nulls)
    return df.withColumn("total_updates", F.col("total_demo_updates") + F.col("total_bio_updates"))


def _with_totals(df: DataFrame, skip_nulls: bool = True) -> DataFrame:
    if "total_updates" not in df.columns:
        df = total_updates(df, skip_nulls)
    return df if "total_enrolment" in df.columns else total_enrolment(df, skip_nulls)


def update_pressure_index(df: DataFrame, name: str = "update_pressure_index") -> DataFrame:
    """Updates per enrolment, 0 without enrolments."""
    df = _with_totals(df)
    return df.withColumn(name, safe_divide("total_updates", "total_enrolment", 0))


def service_workload(df: DataFrame) -> DataFrame:
    return update_pressure_index(df, "service_workload")


def age_transition_rate(df: DataFrame, name: str = "age_transition_rate") -> DataFrame:
    """Adult biometric updates per enrolment aged 5 to 17, 0 where undefined."""
    if not {"bio_age_17_", "age_5_17"} <= set(df.columns):
        return df.withColumn(name, F.lit(0.0))
    return df.withColumn(name, safe_divide("bio_age_17_", "age_5_17", 0))


def youth_update_rate(df: DataFrame) -> DataFrame:
    return age_transition_rate(df, "youth_update_rate")


def demo_bio_ratio(df: DataFrame) -> DataFrame:
    """Demographic per biometric update, null without biometric updates."""
    if "total_demo_updates" not in df.columns:
        df = total_updates(df)
    return df.withColumn("demo_bio_ratio", safe_divide("total_demo_updates", "total_bio_updates"))


def bio_demo_ratio(df: DataFrame) -> DataFrame:
    """Biometric per demographic update, 0 without demographic updates."""
    if "total_demo_updates" not in df.columns:
        df = total_updates(df)
    return df.withColumn("bio_demo_ratio", safe_divide("total_bio_updates", "total_demo_updates", 0))


def child_share(df: DataFrame) -> DataFrame:
    """Percent of enrolments below 18, 0 without enrolments."""
    if "total_enrolment" not in df.columns:
        df = total_enrolment(df)
    return df.withColumn("child_share", safe_divide(sum_with_nulls(["age_0_5", "age_5_17"]), "total_enrolment", 0) * 100)


def previous_value(
    df: DataFrame, names: Sequence[str], keys: Sequence[str], order: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Value of the row before, within a key. Meant for panels: a key has few rows per period."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({prefix + n: F.lag(n).over(w) for n in names})


def previous_value_by_range(
    df: DataFrame, names: Sequence[str], keys: Sequence[str], order: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """As :func:`previous_value`, for rows finer than a panel's, where one key or no key may hold all the data.

    Rows are dealt into even ranges of key and order and written; a range may end in the midst of a key. Within a range the
    row before is found by a window of its own, and a range's first row takes the last row of the range before if
    that has its key. Only those last rows, one a range, meet in one task.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, as drawing the ranges anew could draw them otherwise.
    rows = materialise(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_range", *keys).orderBy(*order)
    lagged = rows.withColumns({"_rn": F.row_number().over(w), **{prefix + n: F.lag(n).over(w) for n in names}})
    key = F.struct(F.lit(0).alias("_any"), *keys)
    last = F.struct(*names, key.alias("_key"))
    ends = rows.groupBy("_range").agg(F.max_by(last, F.struct(*keys, *order)).alias("_end"))
    carried = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_carry"))
    takes = (F.col("_rn") == 1) & key.eqNullSafe(F.col("_carry._key"))
    filled = {prefix + n: F.when(takes, F.col("_carry")[n]).otherwise(F.col(prefix + n)) for n in names}
    return lagged.join(carried, "_range", "left").withColumns(filled).drop("_rn", "_range", "_carry")


def growth_rates(
    df: DataFrame,
    keys: Sequence[str] = ("state", "district"),
    order: Sequence[str] = ("date",),
    metrics: Sequence[str] = GROWTH_METRICS,
    by_range: bool = False,
) -> DataFrame:
    """Row-over-row growth in percent within a key, ``<metric>_growth``.

    ``order`` must be a total order within the key. An empty ``keys`` compares every row with
    the one before it, whatever its place. ``by_range`` is for rows finer than a
    panel's, and always used without keys, so that no task takes a whole key.
    """
    metrics = [m for m in metrics if m in df.columns]
    step = previous_value_by_range if by_range or not keys else previous_value
    lagged = step(df, metrics, keys, order)
    out = lagged.withColumns({f"{m}_growth": growth_percent(m, f"prev_{m}") for m in metrics})
    return out.drop(*[f"prev_{m}" for m in metrics])


def coverage(df: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Enrolments in percent of the population of the district; unchanged without population data."""
    if population is None:
        return df
    joined = df.join(population, ["state", "district"], "left")
    if "population" not in population.columns:
        return joined
    return joined.withColumn(
        "coverage_rate", F.try_divide(F.col("total_enrolment").cast("double"), F.col("population").cast("double")) * 100
    )


def base_indicators(df: DataFrame, growth: bool = True, order: Sequence[str] = ("date",), by_range: bool = False) -> DataFrame:
    """Totals, pressure index, transition rate, demographic/biometric ratio and growth per district."""
    df = demo_bio_ratio(age_transition_rate(update_pressure_index(total_updates(total_enrolment(df)))))
    if growth and "date" in df.columns:
        df = growth_rates(df, order=order, by_range=by_range)
    return df


def panel_indicators(df: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    """The monthly line: totals, workload, rates, shares and growth within the panel's keys.

    The older names of workload, youth rate and child share are added as aliases.
    """
    have = set(df.columns)
    if set(MEASURES["enrolment"]) <= have:
        df = total_enrolment(df, skip_nulls=False)
    if set(MEASURES["demographic"]) <= have:
        df = total_demographic_updates(df, skip_nulls=False)
    if set(MEASURES["biometric"]) <= have:
        df = total_biometric_updates(df, skip_nulls=False)
    have = set(df.columns)
    both = {"total_demo_updates", "total_bio_updates"} <= have
    if both:
        df = df.withColumn("total_updates", F.col("total_demo_updates") + F.col("total_bio_updates"))
    if both and "total_enrolment" in have:
        df = service_workload(df).withColumn("update_pressure_index", F.col("service_workload"))
    if {"bio_age_17_", "age_5_17"} <= have:
        df = youth_update_rate(df).withColumn("age_transition_rate", F.col("youth_update_rate"))
    if "date" in have:
        df = growth_rates(df, keys=keys)
        df = df.withColumnsRenamed(
            {"total_enrolment_growth": "enrolment_growth_rate", "total_updates_growth": "update_growth_rate"}
        )
    if both:
        df = bio_demo_ratio(df)
    if "total_enrolment" in have:
        df = child_share(df).withColumn("child_enrolment_share", F.col("child_share"))
    return df


def workload_class(c: Column | str = "service_workload") -> Column:
    """Low, Normal, High or Very High; Unknown where there is no value."""
    return bucket(c, WORKLOAD_EDGES, "Very High", null="Unknown")


def update_pressure_class(c: Column | str = "update_pressure_index") -> Column:
    return workload_class(c)


def demand_level(c: Column | str, high: float = 0.5, medium: float = 0.2, labels=("High", "Medium", "Low")) -> Column:
    return above(c, [(high, labels[0]), (medium, labels[1])], labels[2])


def update_balance(ratio: Column | str) -> Column:
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(ratio > 1.2, "more demographic").when(ratio < 0.8, "more biometric").otherwise("balanced")
