import pytest
from pyspark.sql import functions as F

from conftest import by, day, months
from tallyworks.operators import anomaly, explore, filters, forest


def frame(spark, **values):
    rows = [(s, d, float(v)) for s, vs in values.items() for d, v in zip(months("2020-01", len(vs)), vs)]
    return spark.createDataFrame(rows, "state string, date date, v double")


def test_zscore_of_lone_and_constant_groups(spark):
    df = frame(spark, one=[5], flat=[3, 3, 3], spiky=[1] * 15 + [100])
    rows = anomaly.detect_zscore(df, "v", 3.0, ["state"]).collect()
    assert all(r.zscore is None and not r.is_anomaly_zscore for r in rows if r.state != "spiky")
    assert [r.v for r in rows if r.is_anomaly_zscore] == [100]


def test_fence_is_strict(spark):
    # quartiles 2 and 4, fences -1 and 7
    df = frame(spark, a=[1, 2, 3, 4, 7], b=[1, 2, 3, 4, 7.01])
    flagged = anomaly.detect_iqr(df, "v", 1.5, ["state"]).where("is_anomaly_iqr").collect()
    assert [(r.state, r.v) for r in flagged] == [("b", 7.01)]
    assert anomaly.detect_iqr(frame(spark, a=[1, 1, 1, 1, 9]), "v").where("is_anomaly_iqr").count() == 1


@pytest.mark.parametrize(
    "z, iqr, forest_flag, grade",
    [
        (4.5, False, False, "Critical"), (-4.5, False, False, "Critical"), (3.5, True, True, "Critical"), (3.5, False, False, "High"),
        (1.0, True, True, "High"), (1.0, True, False, "Medium"), (3.0, False, False, "Low"), (2.5, False, False, "Low"),
        (2.0, False, False, "Normal"), (None, True, False, "Medium"), (None, None, None, "Normal"),
    ],
)
def test_severity(spark, z, iqr, forest_flag, grade):
    df = spark.createDataFrame([(z, iqr, forest_flag)], "zscore double, is_anomaly_iqr boolean, f boolean")
    assert df.select(anomaly.severity(iforest="f")).first()[0] == grade


def test_report_order_and_methods(spark):
    # One extreme month, one mild: with a low threshold the mild one is ungraded and comes last.
    values = [10, 11, 9, 10, 11, 9, 10, 11, 9, 10, 11, 9, 10, 11, 9, 10, 11, 9, 10, 90]
    df = frame(spark, a=values).withColumnRenamed("v", "total_updates")
    report = anomaly.anomaly_report(df, ["total_updates", "absent"], zscore_threshold=3.0, use_isolation_forest=False)
    rows = report.collect()
    assert [(r.value, r.severity, r.detection_methods, r.signal_type) for r in rows] == [(90, "Critical", "Z-Score, IQR", "Operational Signal")]
    low = anomaly.anomaly_report(df, ["total_updates"], zscore_threshold=0.05, use_isolation_forest=False).collect()
    assert low[0].severity == "Critical" and {r.severity for r in low[1:]} == {"Normal"}
    assert [r.date for r in low[1:]] == sorted(r.date for r in low[1:])


def test_summary_and_suggestions(spark):
    rows = [(day("2023-03-01"), "total_updates", 1.0, 5.0, "Critical", "A")] * 2 + [(day("2023-01-01"), "x", 1.0, 3.0, "High", "B")]
    report = spark.createDataFrame(rows, "date date, metric string, value double, zscore double, severity string, state string")
    counts = {(r.dimension, r.key): r.n for r in anomaly.anomaly_summary(report).collect()}
    assert counts == {
        ("severity", "Critical"): 2, ("severity", "High"): 1, ("metric", "total_updates"): 2, ("metric", "x"): 1,
        ("state", "A"): 2, ("state", "B"): 1, ("total", "all"): 3,
    }
    advice = by(anomaly.administrative_suggestions(report), "rule")
    assert set(advice) == {"critical", "metric_total_updates", "states", "months"}
    assert "A, B" in advice["states"].suggestion and "March, January" in advice["months"].suggestion
    empty = report.limit(0)
    assert [r.rule for r in anomaly.administrative_suggestions(empty).collect()] == ["none"]
    assert [(r.dimension, r.n) for r in anomaly.anomaly_summary(empty).collect()] == [("total", 0)]


def test_consensus_counts_absent_as_zero(spark):
    df = spark.createDataFrame([(float(v) if v is not None else None, 1.0) for v in [1] * 20 + [None, 100]], "a double, b double")
    out = anomaly.consensus_zscore(df, ["a", "b"])
    assert out.where("is_anomaly").count() == 1
    assert out.where("b_zscore IS NOT NULL").count() == 0
    rates = by(anomaly.anomaly_rates(out, ["a", "b"]), "metric")
    assert (rates["any"].n, rates["a"].n, rates["b"].n) == (1, 1, 0)


def test_repetition(spark):
    df = spark.createDataFrame([("A", "x", True), ("A", "x", True), ("A", "y", True), ("B", "z", False)], "state string, district string, is_anomaly boolean")
    assert anomaly.repetition_summary(df).first().asDict() == {"single": 1, "repeated": 1, "max_frequency": 2}
    status = anomaly.with_status(df.where("is_anomaly")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in status} == {"Repeated": 2, "Single": 1}


def test_forest_flags_the_share_and_finds_the_outlier(spark):
    rows = [(i, float(i % 17), float(i % 23)) for i in range(1000)] + [(1000, 500.0, 500.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = anomaly.detect_isolation_forest(df, ["a", "b"], contamination=0.05)
    scores = by(out, "id")
    assert max(scores, key=lambda i: scores[i].anomaly_score) == 1000 and scores[1000].is_anomaly_iforest
    share = sum(r.is_anomaly_iforest for r in scores.values()) / len(scores)
    assert 0.02 <= share <= 0.05
    again = by(anomaly.detect_isolation_forest(df.repartition(7), ["a", "b"]), "id")
    assert all(again[i].anomaly_score == scores[i].anomaly_score for i in scores)


def test_forest_samples_are_bounded(spark):
    df = spark.range(3000).select(F.col("id"), F.col("id").cast("double").alias("a"))
    counts = [r["count"] for r in forest.sample_for_trees(df, ["a"], 10, 1).groupBy("tree").count().collect()]
    assert counts == [forest.SAMPLES_PER_TREE] * 10
    few = forest.sample_for_trees(df.where("id < 40"), ["a"], 10, 1).groupBy("tree").count().collect()
    assert [r["count"] for r in few] == [40] * 10


@pytest.mark.parametrize("distinct", [1, 3, 10, 30])
def test_forest_samples_of_repeated_rows(spark, distinct):
    df = spark.range(200_000).select((F.col("id") % distinct).cast("double").alias("a"))
    counts = [r["count"] for r in forest.sample_for_trees(df, ["a"], 100, 1).groupBy("tree").count().collect()]
    assert counts == [forest.SAMPLES_PER_TREE] * 100


def test_every_row_can_reach_a_tree_and_a_hot_one_is_bounded(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1000, -1.0).otherwise(F.col("id").cast("double")).alias("a"))
    sample = forest.sample_for_trees(df, ["a"], 200, 1, samples_per_tree=64)
    assert sample.where("a >= 0").select("a").distinct().count() > 950
    hot = sample.where("a < 0").groupBy("tree").count().agg(F.max("count")).first()[0]
    assert 16 <= hot <= 64


def test_no_rows_make_no_forest(spark):
    df = spark.createDataFrame([], "a double")
    with pytest.raises(ValueError):
        forest.fit_forest(df, ["a"])


def test_filters(spark):
    df = spark.createDataFrame([(day("2023-01-01"), "A", "x"), (day("2023-02-01"), "B", "y")], "date date, state string, district string")
    assert filters.filter_data(df).count() == 2
    assert filters.filter_data(df, ("2023-01-01", "2023-01-01")).count() == 1
    assert filters.filter_data(df, (day("2023-01-02"),)).count() == 2
    assert filters.filter_data(df, state="A", district="y").count() == 0
    choices = {(r.kind, r.choice) for r in filters.filter_choices(df, "A").collect()}
    assert choices == {("first_date", "2023-01-01"), ("last_date", "2023-02-01"), ("state", "A"), ("state", "B"), ("district", "x")}


@pytest.mark.parametrize("n, status", [(4, "too short"), (5, "trend only"), (11, "trend only"), (12, "seasonal")])
def test_history_guard(spark, n, status):
    rows = filters.history_status(frame(spark, a=range(n)), ["state"]).select("status").distinct().collect()
    assert [r.status for r in rows] == [status]


def test_histogram_edges_and_nulls(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (10.0, 5.0), (None, None)], "a double, b double")
    rows = explore.histogram(df, ["a", "b"], 10).collect()
    a = {r.bin: r.n for r in rows if r.metric == "a"}
    assert len(a) == 10 and a[1] == 1 and a[2] == 1 and a[10] == 1 and sum(a.values()) == 3
    b = [r for r in rows if r.metric == "b" and r.n]
    assert len(b) == 1 and b[0].n == 3 and b[0].lower <= 5 <= b[0].upper


def test_sample_is_the_same_on_every_run(spark):
    df = spark.range(1000).select("id")
    first = [r.id for r in explore.repeatable_sample(df, ["id"], 50).collect()]
    assert len(first) == 50 and first == [r.id for r in explore.repeatable_sample(df.repartition(5), ["id"], 50).collect()]


def test_sample_of_repeated_rows(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("id"))
    rows = explore.repeatable_sample(df, ["id"], 5000).collect()
    assert len(rows) == 5000 and {r.id for r in rows} == {0, 1, 2}
