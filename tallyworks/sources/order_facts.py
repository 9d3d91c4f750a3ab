"""The order and line tables read as the three activity facts (mapping in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyworks.schemas import FACT_KEYS, MEASURES, PLACE_KEYS


# The columns read; a declared schema saves a job per table to find it out.
TABLES = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "ts timestamp_ntz, event_type string, value double",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _one_if(condition: Column, name: str) -> Column:
    return condition.cast("long").alias(name)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, district and postal code of every customer."""
    customer = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("district"),
        (100000 + F.col("c_custkey") % 20).cast("string").alias("pincode"),
    )


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.join(places(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), *PLACE_KEYS, "o_orderpriority"
    )


def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; the priority stands for the age band."""
    priority = F.col("o_orderpriority")
    return placed_orders(spark, sf_dir).select(
        *FACT_KEYS,
        _one_if(priority.isin("1-URGENT", "2-HIGH"), "age_0_5"),
        _one_if(priority == "3-MEDIUM", "age_5_17"),
        _one_if(~priority.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "age_18_greater"),
    )


def _is_demographic() -> Column:
    """Returned lines, and of those neither returned nor accepted the ones of odd orders; the rest is biometric."""
    flag = F.col("l_returnflag")
    return (flag == "R") | ((flag == "N") & (F.col("l_orderkey") % 2 == 1))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A", "N"))
    orders = placed_orders(spark, sf_dir).select("o_orderkey", *PLACE_KEYS)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_shipdate").cast("date").alias("date"), *PLACE_KEYS, _is_demographic().alias("demographic"), "l_linestatus"
    )


def demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that stands for a demographic update."""
    status = F.col("l_linestatus")
    return _updates(spark, sf_dir).where("demographic").select(
        *FACT_KEYS, _one_if(status == "F", "demo_age_5_17"), _one_if(status == "O", "demo_age_17_")
    )


def biometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that stands for a biometric update."""
    status = F.col("l_linestatus")
    return _updates(spark, sf_dir).where("NOT demographic").select(
        *FACT_KEYS, _one_if(status == "F", "bio_age_5_17"), _one_if(status == "O", "bio_age_17_")
    )


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "enrolment": enrolment(spark, sf_dir),
        "demographic": demographic(spark, sf_dir),
        "biometric": biometric(spark, sf_dir),
    }


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three facts stacked (the frame ``stack_facts`` makes), joining the lines only once."""
    zero = F.lit(0).cast("long")
    enrolled = enrolment(spark, sf_dir).select(
        *FACT_KEYS,
        F.lit("enrolment").alias("fact"),
        *MEASURES["enrolment"],
        *[zero.alias(m) for m in MEASURES["demographic"] + MEASURES["biometric"]],
    )
    demo, status = F.col("demographic"), F.col("l_linestatus")
    updated = _updates(spark, sf_dir).select(
        *FACT_KEYS,
        F.when(demo, "demographic").otherwise("biometric").alias("fact"),
        *[zero.alias(m) for m in MEASURES["enrolment"]],
        _one_if(demo & (status == "F"), "demo_age_5_17"),
        _one_if(demo & (status == "O"), "demo_age_17_"),
        _one_if(~demo & (status == "F"), "bio_age_5_17"),
        _one_if(~demo & (status == "O"), "bio_age_17_"),
    )
    return enrolled.unionByName(updated)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 people per customer, by state and district."""
    return (
        places(spark, sf_dir)
        .groupBy("state", "district")
        .agg((F.count(F.lit(1)) * 1000).alias("population"))
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-grain rows: date, state (the event type), value."""
    return _table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"), F.col("event_type").alias("state"), "value"
    )
