"""A cross-section of the checked queries against their SQL; ``tools/check_queries.py`` runs all of them."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

SAMPLE = [
    "base_pipeline", "monthly_pipeline_both", "load_csv_folder", "unified_table", "panel_indicators", "base_indicators", "daily_growth",
    "series_daily_mean", "indicator_summary", "histogram", "month_box_statistics", "anomaly_report", "consensus_zscore",
    "district_markers", "recommendations", "trend_line_forecast", "holdout_alignment", "scenario_forecasts", "decomposed_additive",
    "trend_evaluation", "isolation_forest",
]


@pytest.fixture(scope="module")
def oracle():
    return check_queries.oracle(SF_DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, oracle, name):
    verdict = check_queries.check(spark, oracle, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert verdict.startswith(("same", "rows only")), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "metric", "value", "zscore", "severity", "detection_methods", "signal_type", "state"]
    assert df.count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = entry.queries()["anomaly_report_with_forest"](spark, SF_DIR).collect()
            seen.append(sorted(map(str, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and seen[0]
