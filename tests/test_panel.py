import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import by, day
from tallyworks.functions.lineage import materialise
from tallyworks.operators import explore, indicators, panel
from tallyworks.plans import pipelines
from tallyworks.schemas import MEASURES

PLACE = "date date, state string, district string, pincode string"


def fact(spark, kind, rows):
    schema = PLACE + "".join(f", {m} long" for m in MEASURES[kind])
    return spark.createDataFrame([(day(d), *rest) for d, *rest in rows], schema)


@pytest.fixture
def example(spark):
    """The documented example row of each fact."""
    place = ("2023-01-01", "Maharashtra", "Mumbai", "400001")
    return {
        "enrolment": fact(spark, "enrolment", [(*place, 100, 200, 500)]),
        "demographic": fact(spark, "demographic", [(*place, 50, 100)]),
        "biometric": fact(spark, "biometric", [(*place, 40, 90)]),
    }


def test_documented_example(example):
    row = indicators.base_indicators(panel.unify(panel.stack_facts(example))).first()
    assert (row.total_enrolment, row.total_demo_updates, row.total_bio_updates, row.total_updates) == (800, 150, 130, 280)
    assert row.update_pressure_index == 0.35
    assert row.age_transition_rate == 0.45
    assert row.demo_bio_ratio == pytest.approx(150 / 130)
    monthly = indicators.panel_indicators(pipelines.monthly_panel(panel.stack_facts(example)))
    row = monthly.withColumn("class", indicators.workload_class()).first()
    assert row.child_share == 37.5 and row["class"] == "Low"


def test_unify_equals_outer_join(spark):
    facts = {
        "enrolment": fact(spark, "enrolment", [
            ("2023-01-01", "A", "x", "1", 1, 2, 3), ("2023-01-01", "A", "x", "1", 10, 0, 0),
            ("2023-01-02", "A", "x", "1", 5, 5, 5), ("2023-01-02", None, "x", "1", 7, 7, 7),
        ]),
        "demographic": fact(spark, "demographic", [("2023-01-02", "A", "x", "1", 1, 1), ("2023-01-03", "B", "y", "2", 2, 2)]),
        "biometric": fact(spark, "biometric", [("2023-01-03", "B", "y", "2", 3, 3), ("2023-01-04", "B", "y", "2", 4, None)]),
    }
    keys = ["date", "state", "district", "pincode"]
    stacked = panel.unify(panel.stack_facts(facts))
    joined = panel.join_facts([panel.aggregate(df, keys) for df in facts.values()], keys)
    names = sorted(stacked.columns)
    assert sorted(map(tuple, stacked.select(names).collect())) == sorted(map(tuple, joined.select(names).collect()))
    rows = by(stacked, "date", "state")
    assert len(rows) == 4
    assert rows[day("2023-01-01"), "A"].age_0_5 == 11
    assert rows[day("2023-01-04"), "B"].bio_age_17_ == 0


def test_clashing_names_get_a_suffix(spark):
    a = spark.createDataFrame([("A", 1)], "state string, n long")
    b = spark.createDataFrame([("B", 2)], "state string, n long")
    rows = by(panel.join_facts([a, b, b], ["state"]), "state")
    assert rows["A"].asDict() == {"state": "A", "n": 1, "n_demo": 0, "n_bio": 0}
    assert rows["B"].asDict() == {"state": "B", "n": 0, "n_demo": 2, "n_bio": 2}


def test_month_gaps_are_filled(spark):
    df = spark.createDataFrame(
        [(day("2023-01-01"), "A", 5), (day("2023-04-01"), "A", 7), (day("2023-02-01"), "B", None)], "date date, state string, n long"
    )
    rows = by(panel.fill_missing_months(df, ["state"]), "state", "date")
    assert len(rows) == 8
    assert rows["A", day("2023-03-01")].n == 0 and rows["A", day("2023-04-01")].n == 7
    assert rows["B", day("2023-02-01")].n == 0
    national = panel.fill_missing_months(df.groupBy("date").agg(F.sum("n").alias("n")))
    assert national.count() == 4


def test_densify_fills_each_fact_over_its_own_span(spark):
    facts = {
        "enrolment": fact(spark, "enrolment", [("2023-01-05", "A", "x", "1", 1, 0, 0), ("2023-03-05", "A", "x", "1", 1, 0, 0)]),
        "demographic": fact(spark, "demographic", [("2023-05-05", "B", "x", "1", 1, 0)]),
        "biometric": fact(spark, "biometric", [("2023-02-05", "A", "x", "1", 1, 0)]),
    }
    activity = panel.stack_facts(facts)
    rows = by(pipelines.monthly_panel(activity), "state", "date")
    assert set(rows) == {("A", day(f"2023-0{m}-01")) for m in (1, 2, 3)} | {("B", day("2023-05-01"))}
    both = pipelines.monthly_panel(activity, "both")
    assert both.where("level = 'National'").count() == 4
    with pytest.raises(ValueError):
        pipelines.monthly_panel(activity, "planet")


def test_series_of_every_kind(spark):
    df = spark.createDataFrame(
        [("a", day("2023-01-02"), 1.0), ("a", day("2023-01-02"), 4.0), ("a", day("2023-01-05"), 7.0)], "k string, date date, v double"
    )
    values = lambda how, freq="D": [r.value for r in panel.prepare_series(df, "v", ["k"], freq, how).orderBy("date").collect()]
    assert values("sum") == [5, 0, 0, 7]
    assert values("mean") == [2.5, 2.5, 2.5, 7]
    assert values("median") == [2.5, 2.5, 2.5, 7]
    assert values("sum", "M") == [12]
    with pytest.raises(ValueError):
        values("mode")
    with pytest.raises(ValueError):
        values("sum", "H")


def test_fill_both_ways(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "k string, t int, v double")
    rows = by(panel.fill_both_ways(df, "v", ["k"], "t"), "k", "t")
    assert [rows["a", t].v for t in (1, 2, 3)] == [5, 5, 5] and rows["b", 1].v is None


def test_growth_null_for_first_and_after_zero(spark):
    df = spark.createDataFrame(
        [("A", day("2023-01-01"), 0), ("A", day("2023-02-01"), 5), ("A", day("2023-03-01"), 10), ("B", day("2023-03-01"), 1)],
        "state string, date date, total_enrolment long",
    )
    rows = by(indicators.growth_rates(df, ["state"]), "state", "date")
    assert [rows["A", day(f"2023-0{m}-01")].total_enrolment_growth for m in (1, 2, 3)] == [None, None, 100.0]
    assert rows["B", day("2023-03-01")].total_enrolment_growth is None


def test_growth_by_range_equals_plain_window(spark):
    rows = [("A" if i % 3 else "B", f"p{i % 4}", i % 7, i * i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "state string, pincode string, _, total_updates long".replace("_,", "d long,"))
    df = df.withColumn("date", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("total_updates") * 13 + F.col("d") * 40).cast("int")))
    df = df.withColumn("id", F.monotonically_increasing_id())
    df = materialise(df)
    order = ["date", "pincode", "id"]
    plain = indicators.growth_rates(df, ["state"], order)
    split = indicators.growth_rates(df, ["state"], order, by_range=True)
    a, b = by(plain, "id"), by(split, "id")
    assert {k: v.total_updates_growth for k, v in a.items()} == {k: v.total_updates_growth for k, v in b.items()}


def test_ratio_defaults_and_classes(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 1, 0, 0)], ", ".join(f"{m} long" for ms in MEASURES.values() for m in ms))
    row = indicators.bio_demo_ratio(indicators.child_share(indicators.demo_bio_ratio(indicators.update_pressure_index(df)))).first()
    assert (row.update_pressure_index, row.demo_bio_ratio, row.bio_demo_ratio, row.child_share) == (0, None, 0, 0)
    edges = spark.createDataFrame([(0.99,), (1.0,), (2.0,), (5.0,), (None,)], "service_workload double")
    got = [r[0] for r in edges.select(indicators.workload_class()).collect()]
    assert got == ["Low", "Normal", "High", "Very High", "Unknown"]
    demand = spark.createDataFrame([(0.51,), (0.5,), (0.2,)], "x double").select(indicators.demand_level("x")).collect()
    assert [r[0] for r in demand] == ["High", "Medium", "Low"]


def test_nulls_in_totals(spark):
    df = spark.createDataFrame([(1, None, 2)], "age_0_5 long, age_5_17 long, age_18_greater long")
    assert indicators.total_enrolment(df).first().total_enrolment == 3
    assert indicators.total_enrolment(df, skip_nulls=False).first().total_enrolment is None
    assert indicators.total_updates(df).first().total_updates == 0
    assert indicators.age_transition_rate(df).first().age_transition_rate == 0


def test_coverage(spark):
    df = spark.createDataFrame([("A", "x", 5), ("A", "y", 5)], "state string, district string, total_enrolment long")
    people = spark.createDataFrame([("A", "x", 50)], "state string, district string, population long")
    rows = by(indicators.coverage(df, people), "district")
    assert rows["x"].coverage_rate == 10 and rows["y"].coverage_rate is None
    assert indicators.coverage(df).columns == df.columns


def test_summary_counts(spark):
    df = spark.createDataFrame([(day("2023-01-01"), "A", None), (day("2023-01-03"), "B", "x")], "date date, state string, district string")
    row = panel.data_summary(df, "t").first()
    assert (row.rows, row.columns, row.states, row.districts, row.missing_values) == (2, 3, 2, 1, 1)
    assert (row.first_date, row.last_date) == (day("2023-01-01"), day("2023-01-03"))


def test_correlation_over_the_rows_that_have_both(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4)) + 1e6
    x[:, 1] += 2 * x[:, 0]
    table = pd.DataFrame(x, columns=list("abcd"))
    table.loc[::3, "a"] = np.nan
    table.loc[1::5, "b"] = np.nan
    table["flat"], table["one"] = 7.0, np.nan
    table.loc[3, "one"] = 1.0
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "a double, b double, c double, d double, flat double, one double")
    want = table.corr()
    for parts in (1, 7, 600):
        got = {(r.metric_a, r.metric_b): r.correlation for r in explore.correlation(df.repartition(parts)).collect()}
        assert len(got) == 36
        for (a, b), value in got.items():
            w = want.loc[a, b]
            assert value == pytest.approx(w, abs=1e-9) if w == w else value is None, (a, b)
    assert all(r.correlation is None for r in explore.correlation(df.limit(0)).collect())


def test_a_daily_series_of_thirty_years(spark):
    rows = [("a", day("1990-01-01"), 1.0), ("a", day("2019-12-31"), 2.0), ("a", day("2000-02-29"), 3.0), ("b", day("2000-01-01"), 5.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    sums = panel.prepare_series(df, "v", ["k"], "D").toPandas()
    assert len(sums) == 10_957 + 1 and sums["value"].sum() == 11.0
    held = panel.prepare_series(df, "v", ["k"], "D", "mean").where("k = 'a'").groupBy("value").count().collect()
    assert {r.value: r["count"] for r in held} == {1.0: 3711, 3.0: 7245, 2.0: 1}
    plan = panel.prepare_series(df, "v", ["k"], "D")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan
