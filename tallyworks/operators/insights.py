"""Figures and rules behind the recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.functions.columns import safe_divide
from tallyworks.operators.explore import counts_above_mean, seasonality, top_state
from tallyworks.operators.indicators import demand_level, update_balance


def insight_figures(df: DataFrame) -> DataFrame:
    """One row: top state, demand level, districts well above the mean, totals, balance of updates.

    ``df`` is read more than once: pass a stage table.
    """
    totals = df.agg(
        F.avg("update_pressure_index").alias("avg_index"),
        F.sum("total_demo_updates").alias("demo_total"),
        F.sum("total_bio_updates").alias("bio_total"),
    )
    top = top_state(df).select(F.struct("*")).scalar()
    above = counts_above_mean(df).select(F.struct("*")).scalar()
    ratio = F.coalesce(safe_divide("demo_total", "bio_total"), F.lit(0.0))
    return totals.withColumn("_top", top).withColumn("_above", above).select(
        F.col("_top.top_state").alias("top_state"),
        F.col("_top.top_value").alias("top_state_enrolment"),
        "avg_index",
        demand_level("avg_index", labels=("high", "moderate", "low")).alias("demand"),
        F.col("_above.well_above_mean").alias("high_districts"),
        "demo_total",
        "bio_total",
        ratio.alias("demo_bio"),
        update_balance(ratio).alias("balance"),
    )


def recommendations(
    df: DataFrame,
    index_limit: float = 0.3,
    count_limit: int = 100,
    seasonal_limit: float = 1.5,
    ratio_limit: float = 1.3,
) -> DataFrame:
    """(position, rule, insight, action, priority) for the rules that fire; planning always applies."""
    season = seasonality(df).select(F.struct("*")).scalar()
    facts = insight_figures(df).withColumn("_season", season)

    def rule(position: int, name: str, fired: Column, insight: Column, action: str, priority: str) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("rule"),
            F.coalesce(fired, F.lit(False)).alias("fired"),
            insight.alias("insight"),
            F.lit(action).alias("action"),
            F.lit(priority).alias("priority"),
        )

    rules = [
        rule(1, "pressure", F.col("avg_index") > index_limit, F.lit("Updates press on capacity"),
             "Add temporary staff where demand is high", "High"),
        rule(2, "districts", F.col("high_districts") > count_limit,
             F.concat(F.col("high_districts").cast("string"), F.lit(" records well above the mean load")),
             "Shift resources from areas with little demand", "Medium"),
        rule(3, "season", F.col("_season.max_min_ratio") > seasonal_limit,
             F.concat(F.lit("Activity peaks in month "), F.col("_season.peak_month").cast("string")),
             "Bring in resources two to three weeks before the peak", "Medium"),
        rule(4, "balance", F.col("demo_bio") > ratio_limit, F.lit("More demographic than biometric updates"),
             "Even out the work between the centres", "Low"),
        rule(5, "planning", F.lit(True), F.lit("A twelve-month forecast is available"),
             "Plan capacity six to twelve months ahead with it", "High"),
    ]
    return facts.select(F.inline(F.array(*rules))).where("fired").drop("fired").orderBy("position")
