import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def months(first: str, n: int) -> list[dt.date]:
    y, m = int(first[:4]), int(first[5:7]) - 1
    return [dt.date(y + (m + i) // 12, (m + i) % 12 + 1, 1) for i in range(n)]


def make_series(spark, **values):
    """Series table (name, date, value) of monthly values from January 2020."""
    rows = [(name, d, float(v)) for name, vs in values.items() for d, v in zip(months("2020-01", len(vs)), vs)]
    return spark.createDataFrame(rows, "name string, date date, value double")


def by(df, *keys):
    """Rows of a frame by key."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
