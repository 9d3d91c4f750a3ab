import datetime as dt

from pyspark.sql import Observation, functions as F

from conftest import by, day
from tallyworks.functions import columns, dates
from tallyworks.operators import cleaning
from tallyworks.plans import pipelines
from tallyworks.schemas import MEASURES


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_title_case_follows_every_non_letter(spark):
    names = ["  andhra PRADESH ", "o'hara", "dadra-nagar haveli", "ward 7b", "a  b", "", None, "été-sur-mer", "x.y/z(q)"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = by(df.select("i", columns.title_case("n").alias("t")), "i")
    for i, n in enumerate(names):
        assert got[i].t == (None if n is None else n.strip().title())


def test_dates_day_first_in_three_forms(spark):
    cases = {
        "31-01-2023": day("2023-01-31"), "2023-02-01": day("2023-02-01"), "01/03/2023": day("2023-03-01"),
        "x": None, None: None, "32-01-2023": None, "29-02-2023": None, "2023/02/01": day("2023-02-01"), "": None, "1-2-2023": day("2023-02-01"),
        "30-13-2022": None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, d string")
    got = by(df.select("i", dates.parse_date("d").alias("p")), "i")
    assert [got[i].p for i in range(len(cases))] == list(cases.values())


def test_date_forms_and_which_number_comes_first(spark):
    fifth, may = day("2023-02-05"), day("2023-05-02")
    either = ["2023-02-05 00:00:00", "2023-02-05T10:30:00.5Z", "2023/2/5", "5-Feb-2023", "5 February 2023", "\t2023-02-05\n", "\u00a02023-02-05"]
    for text in either:
        for dayfirst in (True, False):
            assert one(spark, text, lambda c: dates.parse_date(c, dayfirst)) == fifth
    for text in (" 05-02-2023", "5/2/2023", "05/02/2023 12:00", "5.2.2023"):
        assert one(spark, text, lambda c: dates.parse_date(c)) == fifth
        assert one(spark, text, lambda c: dates.parse_date(c, dayfirst=False)) == may
    # Where only the other order is a date, it is taken.
    assert one(spark, "25/12/2023", lambda c: dates.parse_date(c, dayfirst=False)) == day("2023-12-25")
    for text in ("2023-02-05 noon", "5-Foo-2023", "31/31/2023", "2023-02-05 25:00", "5 mayor 2023", "99999999", "2023-13", "\u00012023-02-05"):
        assert one(spark, text, lambda c: dates.parse_date(c)) is None


FIFTH = dt.date(2023, 1, 5)


def test_every_form_in_either_order(spark):
    texts = [
        "Jan 5, 2023", "January 5 2023", "20230105", "05-Jan-23", "2023-01-05 10:00 AM", "Thu, 05 Jan 2023", "5th January 2023", "5 of January, 2023",
        "2023 Jan 5", "Thursday 5 Jan 2023 17:45:01.123 UTC", "JAN. 5TH, 2023", "2023-01-05T10:00:00+05:30", "2023.1.5", "  jan 5 2023, 5pm ",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    for dayfirst in (True, False):
        assert {r.d: r.p for r in df.select("d", dates.parse_date("d", dayfirst).alias("p")).collect()} == dict.fromkeys(texts, FIFTH)
    for text, day_first, month_first in [
        ("5/1/23", FIFTH, day("2023-05-01")), ("1/2/2023 5:00 PM", day("2023-02-01"), day("2023-01-02")), ("05 01 2023", FIFTH, day("2023-05-01")),
        ("5.1.68", day("2068-01-05"), day("2068-05-01")), ("5-1-69", day("1969-01-05"), day("1969-05-01")),
    ]:
        assert one(spark, text, lambda c: dates.parse_date(c)) == day_first
        assert one(spark, text, lambda c: dates.parse_date(c, dayfirst=False)) == month_first
    for text in ("2023-01", "Jan 2023", "january, 2023", "2023/1"):
        assert one(spark, text, lambda c: dates.parse_date(c)) == day("2023-01-01")


def test_forms_that_are_asked_for_only(spark):
    texts = ["Jan 5, 2023", "5 Jan 2023", "2023-01", "2023-01-05"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = {r.d: r.p for r in df.select("d", dates.parse_date("d", forms=["day and name"]).alias("p")).collect()}
    # The usual widths need no pattern and are always read.
    assert got == {"Jan 5, 2023": None, "5 Jan 2023": FIFTH, "2023-01": None, "2023-01-05": FIFTH}


def test_votes_and_the_forms_they_choose(spark):
    rows = [("a", "25/12/2023")] * 3 + [("a", "1/2/2023"), ("a", "Jan 5, 2023"), ("b", "x"), ("b", None), ("b", "31/31/2023"), ("b", "12/25/2023")]
    df = spark.createDataFrame(rows, "file string, date string")
    got = {(r.file, r.form): (r.n, r.n_read, r.day_only, r.month_only) for r in cleaning.date_votes(df, by=["file"]).collect()}
    assert got == {("a", "year last"): (4, 4, 3, 0), ("a", "name and day"): (1, 1, 0, 0), ("b", None): (2, 0, 0, 0), ("b", "year last"): (2, 1, 0, 1)}
    assert cleaning.voted_forms(df.where("file = 'a'")) == (("year last", "name and day"), True)
    assert cleaning.voted_forms(df) == (("year last", "name and day"), None)
    assert cleaning.voted_forms(df.limit(0)) == ((), None)
    forms, order = cleaning.voted_forms(df.where("file = 'a'"))
    assert cleaning.parse_dates(df.where("file = 'a'"), dayfirst=order, forms=forms).count() == 5


def test_pipelines_count_what_they_drop(spark):
    keys = "date string, state string, district string, pincode string"
    rows = [("Jan 5, 2023", "north", "a", "1", "4", "5"), ("x", "north", "a", "1", "4", "5"), (None, "north", "a", "1", "4", "5")]
    raw = {f: spark.createDataFrame([r[: 4 + len(MEASURES[f])] + ("1",) * (len(MEASURES[f]) - 2) for r in rows], keys + "".join(f", {m} string" for m in MEASURES[f])) for f in MEASURES}
    for pipeline in (pipelines.preprocess_all, pipelines.clean_monthly):
        for vote in (False, True):
            losses = {}
            assert pipeline(raw, losses=losses, vote=vote).where("date = '2023-01-05'").count() >= 1
            assert {f: (o.get["n_rows"], o.get["invalid_dates"]) for f, o in losses.items()} == dict.fromkeys(raw, (3, 2))


def test_base_line_reads_the_labels_of_equal_rows_once(spark):
    keys = "date string, state string, district string, pincode string"
    rows = [("Jan 5, 2023", " north", "a", None, " 4 ", "5")] * 3 + [("2023-01-05", "NORTH ", "A", "0", "n/a", "-1"), ("x", "north", "a", "1", "4", "5"), ("x", "north", "a", "1", "4", "5"), ("Jan 5, 2023", None, "a", "1", "4", "5")]
    raw = {f: spark.createDataFrame([r[: 4 + len(MEASURES[f])] + ("1",) * (len(MEASURES[f]) - 2) for r in rows], keys + "".join(f", {m} string" for m in MEASURES[f])) for f in MEASURES}
    losses = {}
    out = pipelines.preprocess_all(raw, losses=losses)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {name: [i for i, line in enumerate(plan) if name in line] for name in ("Aggregate [", "initcap")}
    # Every fact is summed by its raw keys below the line that reads its labels.
    assert len(depth["Aggregate ["]) == 1 + len(raw) and all(a < b for a, b in zip(depth["initcap"], depth["Aggregate ["][1:]))
    got = [(r.date, r.state, r.district, r.pincode, *[r[m] for f in MEASURES for m in MEASURES[f][:2]]) for r in out.collect()]
    assert got == [(FIFTH, "North", "A", "0", *[12.0, 14.0] * 3)]
    assert {f: (o.get["n_rows"], o.get["invalid_dates"]) for f, o in losses.items()} == dict.fromkeys(raw, (6, 2))


def test_dates_as_a_column_are_those_of_the_expression(spark):
    texts = [
        "01-02-2023", "01/02/2023", "25/12/2023", "12-25-2023", "01-02/2023", "2023-02-01", "2023/02/01", "1-2-2023", "5/1/68", "5/1/69", "20230105", "2023-01", "5th of Jan, 2023",
        "Thu, 05 Jan 2023 10:00", "32-01-2023", "29-02-2023", "1 -02-2023", "2023-1 -01", "x", "", None, "\u00012023-02-05", " 05-02-2023", "ab-c--d-ef",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    for dayfirst in (True, False):
        for forms in (None, ["month"]):
            want = {r.i: r.p for r in df.select("i", dates.parse_date("d", dayfirst, forms).alias("p")).collect()}
            read = dates.with_date(df, "d", dayfirst, forms)
            assert read.columns == ["i", "d"] and {r.i: r.d for r in read.collect()} == want


def test_dropped_dates_are_counted(spark):
    df = spark.createDataFrame([("31-01-2023",), ("x",), (None,)], "date string")
    seen = Observation()
    assert cleaning.parse_dates(df, observation=seen).count() == 1
    assert seen.get == {"n_rows": 3, "invalid_dates": 2}


def test_numbers(spark):
    values = ["12", " 12 ", "n/a", "-5", None, "NaN", "1e3", "0.5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, age_0_5 string")
    coerced = by(df.select("i", columns.to_number("age_0_5").alias("x")), "i")
    assert [coerced[i].x for i in range(8)] == [12, 12, None, -5, None, None, 1000, 0.5]
    cleaned = by(cleaning.clean_numbers(df, ["age_0_5", "not_there"]), "i")
    assert [cleaned[i].age_0_5 for i in range(8)] == [12, 12, 0, 0, 0, 0, 1000, 0.5]


def test_standardise_and_missing(spark):
    df = spark.createDataFrame(
        [
            ("2023-01-05", " north ", "a-b", "100", "4"),
            ("bad", "north", "a", "100", "x"),
            ("05-01-2023", None, "a", "100", "1"),
            ("05/01/2023", "south", None, "100", "1"),
        ],
        " Date string, STATE string, District string, pincode string, ` Age_0_5 ` string",
    )
    std = cleaning.standardise(df)
    assert std.columns == ["date", "state", "district", "pincode", "age_0_5"]
    rows = std.collect()
    assert rows[0] == (dt.date(2023, 1, 5), "North", "A-B", "100", 4.0)
    assert rows[1].date is None and rows[1].age_0_5 is None
    kept = cleaning.handle_missing(std).collect()
    assert [r.state for r in kept] == ["North"]
    counts = cleaning.missing_cells(std).first()
    # one bad date, one bad number, one state, one district
    assert counts.asDict() == {"rows_before": 4, "rows_after": 1, "missing_before": 4, "missing_after": 0}


def test_safe_divide_and_classes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None), (1.0, -1.0)], "a double, b double")
    rows = df.select(columns.safe_divide("a", "b", 0).alias("z"), columns.safe_divide("a", "b").alias("n")).collect()
    assert [(r.z, r.n) for r in rows] == [(0.5, 0.5), (0.0, None), (0.0, None), (0.0, None)]


def test_period_bounds_and_future(spark):
    df = spark.createDataFrame([(day("2023-01-31"),)], "d date")
    starts = df.select(*[columns.period_start("d", f).alias(f) for f in "DWMQY"]).first()
    assert list(starts) == [day(x) for x in ("2023-01-31", "2023-01-30", "2023-01-01", "2023-01-01", "2023-01-01")]
    ends = df.select(*[columns.period_end(columns.period_start("d", f), f).alias(f) for f in "DWMQY"]).first()
    assert list(ends) == [day(x) for x in ("2023-01-31", "2023-02-05", "2023-01-31", "2023-03-31", "2023-12-31")]
    future = {f: [r.date for r in columns.explode_future(df, "d", 2, f).orderBy("step").collect()] for f in ("MS", "M", "Q", "Y", "D", "W")}
    assert future == {
        "MS": [day("2023-02-01"), day("2023-03-01")], "M": [day("2023-02-28"), day("2023-03-31")],
        "Q": [day("2023-06-30"), day("2023-09-30")], "Y": [day("2024-12-31"), day("2025-12-31")],
        "D": [day("2023-02-01"), day("2023-02-02")], "W": [day("2023-02-07"), day("2023-02-14")],
    }


def test_lost_dates_are_told_apart(spark):
    df = spark.createDataFrame([("31-01-2023",), ("x",), (None,), ("5-Jan-2023",)], "date string")
    assert tuple(cleaning.date_losses(df).first()) == (4, 1, 1)


def test_numbers_and_blanks_as_written(spark):
    for text, want in (("12d", None), ("12f", None), ("\t7\n", 7.0), ("+.5", 0.5), ("1,000", None), ("Infinity", None)):
        assert one(spark, text, columns.to_number) == want
    assert one(spark, "\tnew delhi\u00a0\n", columns.title_case) == "New Delhi"
