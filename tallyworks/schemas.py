"""Column names and schemas of the three activity facts."""

from __future__ import annotations

from pyspark.sql import types as T

PLACE_KEYS = ["state", "district", "pincode"]
FACT_KEYS = ["date", *PLACE_KEYS]

# The measure columns of each fact.
MEASURES = {
    "enrolment": ["age_0_5", "age_5_17", "age_18_greater"],
    "demographic": ["demo_age_5_17", "demo_age_17_"],
    "biometric": ["bio_age_5_17", "bio_age_17_"],
}
ALL_MEASURES = [m for names in MEASURES.values() for m in names]

# The totals most reports look at.
HEADLINE_METRICS = ["total_enrolment", "total_updates", "update_pressure_index"]


def raw_schema(fact: str) -> T.StructType:
    """Every raw column is text; cleaning decides what a bad value becomes."""
    return T.StructType([T.StructField(c, T.StringType()) for c in FACT_KEYS + MEASURES[fact]])


def clean_schema(fact: str, measure_type: T.DataType | None = None) -> T.StructType:
    """Schema of a cleaned fact, used when a stage is loaded again."""
    measure = measure_type or T.DoubleType()
    return T.StructType(
        [T.StructField("date", T.DateType())]
        + [T.StructField(c, T.StringType()) for c in PLACE_KEYS]
        + [T.StructField(c, measure) for c in MEASURES[fact]]
    )
