"""One place holds most of the rows: results stay whole and equal to plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyworks.functions.lineage import materialise
from tallyworks.operators import anomaly, explore, indicators, panel
from tallyworks.operators.stats import with_group_stats


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows, two thirds of them in one state; aggressive thresholds make AQE split it."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("state"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("date"),
        (F.pmod(F.xxhash64("id"), F.lit(1000))).alias("total_updates"),
        F.col("id"),
    )
    return materialise(rows, "hot")


@pytest.fixture(scope="module")
def plain(hot):
    return hot.toPandas()


def test_group_statistics(hot, plain, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = with_group_stats(hot, ["state"], {"m": F.avg("total_updates")}).select("id", "m").toPandas().set_index("id").m
            want = plain.groupby("state").total_updates.transform("mean").set_axis(plain.id)
            assert np.allclose(got.sort_index(), want.sort_index())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fences(hot, plain):
    got = set(r.id for r in anomaly.detect_iqr(hot, "total_updates", 0.1, ["state"]).where("is_anomaly_iqr").select("id").collect())
    q1 = plain.groupby("state").total_updates.transform(lambda x: x.quantile(0.25))
    q3 = plain.groupby("state").total_updates.transform(lambda x: x.quantile(0.75))
    outside = (plain.total_updates < q1 - 0.1 * (q3 - q1)) | (plain.total_updates > q3 + 0.1 * (q3 - q1))
    assert got == set(plain.id[outside]) and got


def test_growth_of_daily_rows(hot, plain):
    grown = indicators.growth_rates(hot, ["state"], ["date", "id"], ["total_updates"], by_range=True)
    got = grown.select("id", "total_updates_growth").toPandas().set_index("id").total_updates_growth.sort_index()
    ordered = plain.sort_values(["state", "date", "id"])
    want = ordered.groupby("state").total_updates.pct_change().mul(100).replace([np.inf, -np.inf], np.nan)
    want = pd.Series(want.values, index=ordered.id).sort_index()
    assert np.allclose(got, want, equal_nan=True)


def test_sums_and_description(hot, plain):
    sums = {r.state: r.total_updates for r in panel.aggregate(hot, ["state"], ["total_updates"]).collect()}
    assert sums == plain.groupby("state").total_updates.sum().to_dict()
    row = explore.describe(hot, ["total_updates"]).first()
    want = plain.total_updates.describe()
    assert (row["count"], row.min, row.q25, row.median, row.q75, row.max) == tuple(want[["count", "min", "25%", "50%", "75%", "max"]])
    assert row["std"] == pytest.approx(want["std"])
