import math

import pytest
from pyspark.sql import functions as F

from conftest import by, day
from tallyworks.functions import lineage
from tallyworks.operators import explore, geo, insights
from tallyworks.plans import pipelines
from tallyworks.schemas import clean_schema, raw_schema
from tallyworks.sources import files

ENROL = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_named_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_datasets(spark, str(tmp_path))
    write(tmp_path / "enrolment.csv", ENROL + "2023-01-01,maharashtra ,Mumbai,400001,100,200,500\n")
    write(tmp_path / "demographic_updates.csv", "date,state,district,pincode,demo_age_5_17,demo_age_17_\n2023-01-01,Maharashtra,Mumbai,400001,50,100\n")
    write(tmp_path / "biometric_updates.csv", "date,state,district,pincode,bio_age_5_17,bio_age_17_\n2023-01-01,Maharashtra,Mumbai,400001,40,90\n")
    rows = pipelines.preprocess_folder(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].state == "Maharashtra" and rows[0].pincode == "400001"
    assert rows[0].age_18_greater == 500 and rows[0].bio_age_17_ == 90


def test_folder_with_different_headers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_csv_folder(spark, str(tmp_path))
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    write(tmp_path / "b.csv", 'y,x,"z,z"\n4,3,"q, r"\n')
    write(tmp_path / "c.csv", "x,y\n5,6\n")
    write(tmp_path / "notes.txt", "x,y\n9,9\n")
    rows = {r.x: (r.y, r["z,z"]) for r in files.load_csv_folder(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("2", None), "3": ("4", "q, r"), "5": ("6", None)}


def test_headers_of_many_small_files(spark, tmp_path):
    kinds = ["x,y", "y,x", "x,y,\"z,z\""]
    for i in range(240):
        write(tmp_path / f"{i:04}.csv", ("\ufeff" if i % 7 == 0 else "") + kinds[i % 3] + "\n" + "\n".join(f"{i},{j},0"[: None if i % 3 == 2 else -2] for j in range(i % 4)) + "\n")
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "long.csv", "x,y\n" + "1,2\n" * 30_000)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = files.headers(spark, [str(p) for p in sorted(tmp_path.iterdir())])
    assert {names: len(paths) for names, paths in found.items()} == {("x", "y"): 81, ("y", "x"): 80, ("x", "y", "z,z"): 80}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    rows = files.load_csv_folder(spark, str(tmp_path))
    assert rows.count() == sum(i % 4 for i in range(240)) + 30_000
    assert rows.where("`z,z` is not null").count() == sum(i % 4 for i in range(2, 240, 3))
    for p in tmp_path.iterdir():
        write(p, "")
    with pytest.raises(ValueError, match="header"):
        files.load_csv_folder(spark, str(tmp_path))


def test_two_folders_of_a_fact_are_an_error(spark, tmp_path):
    for name in ("old_enrolment", "new_enrolment"):
        write(tmp_path / name / "a.csv", ENROL + f"2023-01-01,{name},x,1,1,2,3\n")
    with pytest.raises(ValueError, match="Several folders"):
        files.load_enrolment(spark, str(tmp_path))
    assert [r.state for r in files.load_enrolment(spark, str(tmp_path), "old_enrolment").collect()] == ["old_enrolment"]
    with pytest.raises(FileNotFoundError):
        files.load_biometric(spark, str(tmp_path))


def test_required_columns(spark, tmp_path):
    write(tmp_path / "export_enrolment" / "a.csv", "date,state\n2023-01-01,A\n")
    with pytest.raises(ValueError, match="age_0_5"):
        files.load_enrolment(spark, str(tmp_path))


def test_monthly_from_folders(spark, tmp_path):
    write(tmp_path / "export_enrolment" / "a.csv", ENROL + "15-01-2023,A,x,1,1,2,-3\n20-03-2023,A,x,1,1,n/a,\n")
    write(tmp_path / "export_demographic" / "a.csv", "date,state,district,pincode,demo_age_5_17,demo_age_17_\n01-02-2023,A,x,1,5,5\n")
    write(tmp_path / "export_biometric" / "a.csv", "date,state,district,pincode,bio_age_5_17,bio_age_17_\nbad,A,x,1,5,5\n")
    rows = by(pipelines.load_monthly(spark, str(tmp_path), "national"), "date")
    assert set(rows) == {day(f"2023-0{m}-01") for m in (1, 2, 3)}
    assert rows[day("2023-01-01")].age_18_greater == 0 and rows[day("2023-02-01")].demo_age_17_ == 5
    assert rows[day("2023-03-01")].age_0_5 == 1 and rows[day("2023-03-01")].bio_age_17_ == 0


def test_csv_and_parquet_stages(spark, tmp_path):
    df = spark.createDataFrame([(day("2023-01-31"), "A", "x", "007", 1.0, 2.0, 3.0)], clean_schema("enrolment"))
    path = files.save_csv(df, str(tmp_path / "out"))
    assert files.load_csv_stage(spark, path, clean_schema("enrolment")).collect() == df.collect()
    stage = files.save_by_month(df, str(tmp_path / "stage"))
    assert (tmp_path / "stage" / "month=2023-01").exists()
    assert files.load_stage(spark, stage).drop("month").collect() == df.collect()
    assert raw_schema("enrolment").names == df.columns


def test_stage_tables(spark, tmp_path):
    df = lineage.materialise(spark.range(5).where("id > 1"), "t")
    assert df.count() == 3 and "FileScan parquet" in df._jdf.queryExecution().toString()
    named = spark.conf.get(lineage.CHECKPOINT_CONF, None)
    path = lineage.stage_path(spark, "x")
    assert path != lineage.stage_path(spark, "x")
    assert path.startswith(named or lineage.stage_dir(spark))


class Named:
    """A session with these settings."""

    def __init__(self, **settings):
        self.conf, self.settings = self, settings
        self.sparkContext = type("Context", (), {"applicationId": "app"})

    def get(self, key, *default):
        return self.settings.get(key.split(".")[-2], *default)


def test_stages_lie_in_a_folder_that_is_shared():
    assert lineage.stage_dir(Named(checkpoint="hdfs:///c/", warehouse="hdfs:///w")) == "hdfs:///c"
    assert lineage.stage_dir(Named(warehouse="hdfs:///w/")) == "hdfs:///w/_stages/app"


def panel(spark):
    rows = [
        (day("2023-01-01"), "Goa", "a", 10, 4, 2), (day("2023-02-01"), "Goa", "b", 30, 4, 2),
        (day("2023-01-01"), "Kerala", "a", 40, 2, 6), (day("2023-01-01"), "Nowhere", "a", 100, 1, 1),
    ]
    df = spark.createDataFrame(rows, "date date, state string, district string, total_enrolment long, total_demo_updates long, total_bio_updates long")
    df = df.withColumn("total_updates", F.col("total_demo_updates") + F.col("total_bio_updates"))
    return df.withColumn("update_pressure_index", F.col("total_updates") / F.col("total_enrolment"))


def test_state_markers(spark):
    rows = by(geo.state_markers(panel(spark)), "state")
    assert set(rows) == {"Goa", "Kerala"}
    # shades are relative to all states, also the one without coordinates
    assert rows["Goa"].normalized == 0 and rows["Goa"].color == "green" and rows["Goa"].radius == 10
    assert (rows["Kerala"].lat, rows["Kerala"].lon) == (10.8505, 76.2711)


def test_district_markers(spark):
    rows = by(geo.district_markers(panel(spark)), "state", "district")
    assert rows["Kerala", "a"].normalized == 0.5 and rows["Kerala", "a"].color == "orange"
    assert rows["Goa", "a"].color == "green" and rows["Goa", "b"].color == "red"
    assert rows["Goa", "a"].lat == pytest.approx(15.2993 + 0.5) and rows["Goa", "b"].lat == pytest.approx(15.2993 - 0.5)
    assert rows["Nowhere", "a"].lon == pytest.approx(78.9629 + 0.5 * math.sin(0))
    assert geo.district_markers(panel(spark), "Goa").count() == 2


@pytest.mark.parametrize("n, state, district", [(0.33, "orange", "green"), (0.67, "red", "orange"), (0.5, "orange", "orange"), (0.68, "red", "red")])
def test_shade_edges(spark, n, state, district):
    row = spark.createDataFrame([(n,)], "normalized double").select(geo.state_shade(), geo.district_shade()).first()
    assert tuple(row) == (state, district)


def test_figures_and_rules(spark):
    df = panel(spark)
    figures = insights.insight_figures(df).first()
    assert (figures.top_state, figures.top_state_enrolment, figures.demo_total, figures.bio_total) == ("Nowhere", 100, 11, 11)
    assert figures.balance == "balanced" and figures.demand == "moderate"
    assert [r.rule for r in insights.recommendations(df, index_limit=0.9).collect()] == ["season", "planning"]
    assert "pressure" in [r.rule for r in insights.recommendations(df, index_limit=0.01).collect()]
    stats = geo.map_statistics(df).first()
    assert (stats.states, stats.top_state, stats.avg_enrolment_per_state) == (3, "Nowhere", 60)


def test_rankings_have_a_full_tie_break(spark):
    df = panel(spark).withColumn("update_pressure_index", F.lit(1.0))
    top = explore.top_districts(df, n=2).collect()
    assert [r.location for r in top] == ["Goa - a", "Goa - b"]
    with pytest.raises(ValueError):
        explore.top_districts(df, metric="absent")
    ties = df.withColumn("total_enrolment", F.lit(1)).where("district = 'a'")
    assert explore.top_state(ties).first().top_state == "Goa"
