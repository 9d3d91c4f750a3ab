"""Sources, cleaning and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.common import (
    BASE_FLOATS, ENROL, FACTS, MEASURE_NAMES, MEASURES, MEASURES_TEXT, PANEL, PANEL_FLOATS, TOTALS_TEXT,
    DISTRICTS, dense, districts, joined, monthly, outer_joined, panel, query, shown, sums,
)
from tallyworks.functions import columns, dates
from tallyworks.functions.lineage import stage_path
from tallyworks.operators import cleaning
from tallyworks.plans import pipelines
from tallyworks.schemas import clean_schema
from tallyworks.sources import files, order_facts

# Facts as they arrive: text in every column, blanks around names and places, three date
# forms and some that are none, numbers with blanks, below zero, missing or not numbers.
# The same date forms in Spark's and in DuckDB's patterns.
SPARK_FORMS = [
    "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "' 'dd-MM-yyyy", "d/M/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "d-MMM-yyyy",
    "MMM d, yyyy", "MMMM d yyyy", "yyyyMMdd", "d/M/yy", "dd-MMM-yy", "yyyy-MM", "yyyy-MM-dd hh:mm a", "d/M/yyyy h:mm a", "EEE, dd MMM yyyy", "d'th' MMMM yyyy",
]
SQL_FORMS = [
    "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", " %d-%m-%Y", "%-d/%-m/%Y", "%Y-%m-%d 00:00:00", "%Y-%m-%dT00:00:00", "%Y/%m/%d", "%-d-%b-%Y",
    "%b %-d, %Y", "%B %-d %Y", "%Y%m%d", "%-d/%-m/%y", "%d-%b-%y", "%Y-%m", "%Y-%m-%d 12:00 AM", "%-d/%-m/%Y 12:00 AM", "%a, %d %b %Y", "%-dth %B %Y",
]
RAW_NAMES = {"enrol": "enrolment", "demo": "demographic", "bio": "biometric"}


def raw_fact(spark: SparkSession, sf_dir: str, fact: str, messy_names: bool = False) -> DataFrame:
    source = order_facts.facts(spark, sf_dir)[fact]
    day = F.day("date")
    date = F.when(day == 13, F.lit("x")).when(day == 29, F.lit(None))
    for i, form in enumerate(SPARK_FORMS[:-1]):
        date = date.when(day % len(SPARK_FORMS) == i, F.date_format("date", form))
    date = date.otherwise(F.date_format("date", SPARK_FORMS[-1]))
    state = F.when(F.col("pincode") != "100007", F.concat(F.lit("  "), F.lower("state"), F.lit("-o'hara east ")))
    out = source.select(
        date.alias("date"),
        state.alias("state"),
        F.concat(F.lit(" "), F.upper("district")).alias("district"),
        "pincode",
        *[
            F.when(day == 5, F.lit("n/a")).when(day == 6, F.lit("-5")).when(day == 7, F.lit(None))
            .otherwise(F.concat(F.lit(" "), F.col(m).cast("string"), F.lit(" "))).alias(m)
            for m in MEASURE_NAMES[[k for k, v in RAW_NAMES.items() if v == fact][0]]
        ],
    )
    return out.toDF(*[f" {c.upper()} " for c in out.columns]) if messy_names else out


def raw_sql(fact: str) -> str:
    """CTE ``raw_<fact>``."""
    numbers = ", ".join(
        f"CASE WHEN day(date) = 5 THEN 'n/a' WHEN day(date) = 6 THEN '-5' WHEN day(date) = 7 THEN NULL "
        f"ELSE ' ' || CAST({m} AS VARCHAR) || ' ' END AS {m}"
        for m in MEASURE_NAMES[fact]
    )
    forms = " ".join(f"WHEN day(date) % {len(SQL_FORMS)} = {i} THEN strftime(date, '{form}')" for i, form in enumerate(SQL_FORMS))
    return f"""raw_{fact} AS (SELECT CASE WHEN day(date) = 13 THEN 'x' WHEN day(date) = 29 THEN NULL {forms} END AS date,
    CASE WHEN pincode <> '100007' THEN '  ' || lower(state) || '-o''hara east ' END AS state,
    ' ' || upper(district) AS district, pincode, {numbers} FROM {fact})"""


_TRIMMED = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


# A date text without blanks, week day, time and the letters of an ordinal.
DATE_TEXT = "regexp_replace(regexp_replace(regexp_replace({0}, '^[A-Z][a-z]{{2}}, ', ''), '[T ][0-9]{{2}}:.*$', ''), '([0-9])th ', '\\1 ')".format(_TRIMMED.format("date"))
SHORT_YEAR = rf"regexp_matches({DATE_TEXT}, '^[0-9]{{1,2}}[^0-9].*[^0-9][0-9]{{2}}$')"


def date_sql(dayfirst: bool) -> str:
    """A date text read by DuckDB's own forms, with the day or the month first; the other order where only that is a date."""
    orders = [["%d-%m-", "%d/%m/"], ["%m-%d-", "%m/%d/"]]
    first, second = orders if dayfirst else orders[::-1]
    long = ["%Y-%m-%d", "%Y/%m/%d", *[f + "%Y" for f in first], "%d-%b-%Y", "%b %d, %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y", *[f + "%Y" for f in second], "%Y%m%d", "%Y-%m"]
    short = [*[f + "%y" for f in first], "%d-%b-%y", *[f + "%y" for f in second]]
    return f"CAST(CASE WHEN {SHORT_YEAR} THEN try_strptime({DATE_TEXT}, {short}) ELSE try_strptime({DATE_TEXT}, {long}) END AS DATE)"


# The monthly line reads the day first, the base line the month.
DATE_SQL, BASE_DATE_SQL = date_sql(True), date_sql(False)


def title_sql(c: str) -> str:
    words = rf"regexp_extract_all(lower({_TRIMMED.format(c)}), '(\p{{L}}+|[^\p{{L}}]+)')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), '')"


def number_sql(c: str) -> str:
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


RAW_ENROL = joined(ENROL, raw_sql("enrol"))
ENROL_NAMES = MEASURE_NAMES["enrol"]
ENROL_TEXT = " ".join(ENROL_NAMES)


@query("normalised_names", shown("SELECT * FROM raw_enrol", dates="", ctes=RAW_ENROL))
def _(spark, sf_dir):
    return cleaning.normalise_names(raw_fact(spark, sf_dir, "enrolment", messy_names=True))


@query("coerced_dates", shown(f"SELECT date AS raw, {DATE_SQL} AS date, pincode FROM raw_enrol", ctes=RAW_ENROL))
def _(spark, sf_dir):
    raw = raw_fact(spark, sf_dir, "enrolment")
    return raw.select(F.col("date").alias("raw"), dates.parse_date("date").alias("date"), "pincode")


@query(
    "parsed_dates",
    shown(f"SELECT * FROM (SELECT * REPLACE ({DATE_SQL} AS date) FROM raw_enrol) WHERE date IS NOT NULL", ctes=RAW_ENROL),
)
def _(spark, sf_dir):
    return cleaning.parse_dates(raw_fact(spark, sf_dir, "enrolment"))


def votes_sql(by: str = "") -> str:
    """Forms by the looks of the texts, and what shows their order."""
    looks = {
        "year first": "^[0-9]{4}[-/][0-9]+[-/][0-9]+$", "year last": "^[0-9]+[-/][0-9]+[-/][0-9]{4}$", "short year": "^[0-9]+[-/][0-9]+[-/][0-9]{2}$",
        "eight digits": "^[0-9]{8}$", "day and name": "^[0-9]{1,2}[- ][A-Z][a-z]+[- ][0-9]+$", "name and day": "^[A-Z][a-z]+ [0-9]{1,2},? [0-9]{4}$", "month": "^[0-9]{4}-[0-9]{2}$",
    }
    form = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in looks.items())
    number = "TRY_CAST(regexp_extract(t, '^([0-9]{{1,2}})[-/]([0-9]{{1,2}})[-/]', {0}) AS INT)".format
    count = "CAST(count(*) FILTER ({0}) AS BIGINT) AS {1}".format
    return f"""SELECT {by}form, CAST(count(*) AS BIGINT) AS n, {count("read IS NOT NULL", "n_read")},
      {count("form IN ('year last', 'short year') AND read IS NOT NULL AND " + number(1) + " > 12", "day_only")},
      {count("form IN ('year last', 'short year') AND read IS NOT NULL AND " + number(2) + " > 12", "month_only")}
    FROM (SELECT *, CASE {form} END AS form FROM (SELECT *, {DATE_TEXT} AS t, {DATE_SQL} AS read FROM raw_enrol)) GROUP BY ALL"""


@query("date_votes", shown(votes_sql(), dates="", ctes=RAW_ENROL))
def _(spark, sf_dir):
    return cleaning.date_votes(raw_fact(spark, sf_dir, "enrolment"))


@query("date_votes_by_group", shown(votes_sql("pincode, "), dates="", ctes=RAW_ENROL))
def _(spark, sf_dir):
    return cleaning.date_votes(raw_fact(spark, sf_dir, "enrolment"), by=["pincode"])


@query(
    "date_losses",
    shown(
        f"SELECT count(*) AS n_rows, count(*) FILTER (date IS NULL) AS no_date, count(*) FILTER (date IS NOT NULL AND {DATE_SQL} IS NULL) AS unreadable FROM raw_enrol",
        whole="n_rows no_date unreadable", dates="", ctes=RAW_ENROL,
    ),
)
def _(spark, sf_dir):
    return cleaning.date_losses(raw_fact(spark, sf_dir, "enrolment"))


@query(
    "title_case_places",
    shown(
        f"SELECT state AS raw, {title_sql('state')} AS state, {title_sql('district')} AS district, count(*) AS n "
        "FROM raw_enrol GROUP BY ALL", whole="n", dates="", ctes=RAW_ENROL,
    ),
)
def _(spark, sf_dir):
    raw = raw_fact(spark, sf_dir, "enrolment")
    placed = raw.select(
        F.col("state").alias("raw"), columns.title_case("state").alias("state"), columns.title_case("district").alias("district")
    )
    return placed.groupBy("raw", "state", "district").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coerced_numbers",
    shown(
        f"SELECT pincode, {', '.join(f'{m} AS raw_{m}, {number_sql(m)} AS {m}' for m in ENROL_NAMES)} FROM raw_enrol",
        floats=ENROL_TEXT, dates="", ctes=RAW_ENROL,
    ),
)
def _(spark, sf_dir):
    raw = raw_fact(spark, sf_dir, "enrolment")
    return raw.select(
        "pincode", *[c for m in ENROL_NAMES for c in (F.col(m).alias(f"raw_{m}"), columns.to_number(m).alias(m))]
    )


def standard_sql(fact: str) -> str:
    numbers = ", ".join(f"{number_sql(m)} AS {m}" for m in MEASURE_NAMES[fact])
    return (
        f"std_{fact} AS (SELECT {BASE_DATE_SQL} AS date, {title_sql('state')} AS state, {title_sql('district')} AS district, "
        f"pincode, {numbers} FROM raw_{fact})"
    )


@query("standardised_fact", shown("SELECT * FROM std_enrol", floats=ENROL_TEXT, ctes=joined(RAW_ENROL, standard_sql("enrol"))))
def _(spark, sf_dir):
    return cleaning.standardise(raw_fact(spark, sf_dir, "enrolment", messy_names=True))


FILLED = ", ".join(f"coalesce({m}, 0) AS {m}" for m in ENROL_NAMES)


@query(
    "filled_numbers",
    shown(f"SELECT date, state, district, pincode, {FILLED} FROM std_enrol", floats=ENROL_TEXT, ctes=joined(RAW_ENROL, standard_sql("enrol"))),
)
def _(spark, sf_dir):
    return cleaning.fill_numbers(cleaning.standardise(raw_fact(spark, sf_dir, "enrolment")))


COMPLETE = "state IS NOT NULL AND district IS NOT NULL AND date IS NOT NULL"


@query(
    "placed_rows",
    shown(f"SELECT * FROM std_enrol WHERE {COMPLETE}", floats=ENROL_TEXT, ctes=joined(RAW_ENROL, standard_sql("enrol"))),
)
def _(spark, sf_dir):
    return cleaning.drop_unplaced(cleaning.standardise(raw_fact(spark, sf_dir, "enrolment")))


@query(
    "handled_missing",
    shown(
        f"SELECT date, state, district, pincode, {FILLED} FROM std_enrol WHERE {COMPLETE}",
        floats=ENROL_TEXT, ctes=joined(RAW_ENROL, standard_sql("enrol")),
    ),
)
def _(spark, sf_dir):
    return cleaning.handle_missing(cleaning.standardise(raw_fact(spark, sf_dir, "enrolment")))


_COLUMNS = ["date", "state", "district", "pincode", *ENROL_NAMES]


@query(
    "missing_cells",
    shown(
        f"""SELECT count(*) AS rows_before, count(*) FILTER ({COMPLETE}) AS rows_after,
        {' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in _COLUMNS)} AS missing_before,
        count(*) FILTER ({COMPLETE} AND pincode IS NULL) AS missing_after FROM std_enrol""",
        whole="rows_before rows_after missing_before missing_after", dates="", ctes=joined(RAW_ENROL, standard_sql("enrol")),
    ),
)
def _(spark, sf_dir):
    return cleaning.missing_cells(cleaning.standardise(raw_fact(spark, sf_dir, "enrolment")))


def clean_sql(fact: str) -> str:
    numbers = ", ".join(f"greatest(coalesce({number_sql(m)}, 0), 0) AS {m}" for m in MEASURE_NAMES[fact])
    return (
        f"clean_{fact} AS (SELECT * FROM (SELECT {DATE_SQL} AS date, state, district, pincode, {numbers} FROM raw_{fact}) "
        "WHERE date IS NOT NULL)"
    )


@query(
    "cleaned_numbers",
    shown(
        f"SELECT date, state, district, pincode, {', '.join(f'greatest(coalesce({number_sql(m)}, 0), 0) AS {m}' for m in ENROL_NAMES)} FROM raw_enrol",
        floats=ENROL_TEXT, dates="", ctes=RAW_ENROL,
    ),
)
def _(spark, sf_dir):
    return cleaning.clean_numbers(raw_fact(spark, sf_dir, "enrolment"), ENROL_NAMES)


for _short, _fact in RAW_NAMES.items():

    @query(
        f"clean_{_fact}",
        shown(f"SELECT * FROM clean_{_short}", floats=" ".join(MEASURE_NAMES[_short]), ctes=joined(FACTS, raw_sql(_short), clean_sql(_short))),
    )
    def _(spark, sf_dir, fact=_fact):
        return cleaning.clean_fact(raw_fact(spark, sf_dir, fact), fact)


@query(
    "dashboard_columns",
    shown(
        "SELECT date, state, 'All Districts' AS district, total_enrolment, total_updates, total_demo_updates, "
        "total_bio_updates, update_pressure_index FROM panel",
        floats="update_pressure_index", whole=TOTALS_TEXT, ctes=PANEL,
    ),
)
def _(spark, sf_dir):
    return pipelines.dashboard_panel(order_facts.activity(spark, sf_dir)).select(
        "date", "state", "district", "total_enrolment", "total_updates", "total_demo_updates", "total_bio_updates",
        "update_pressure_index",
    )


@query(
    "place_labels",
    shown("SELECT state || ' - ' || district AS location, count(*) AS n FROM enrol GROUP BY 1", whole="n", dates="", ctes=ENROL),
)
def _(spark, sf_dir):
    enrolled = order_facts.enrolment(spark, sf_dir)
    return enrolled.groupBy(columns.place_label().alias("location")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_parts",
    shown(
        "SELECT date, month(date) AS month, monthname(date) AS month_name, quarter(date) AS quarter, count(*) AS n FROM enrol GROUP BY ALL",
        whole="month quarter n", ctes=ENROL,
    ),
)
def _(spark, sf_dir):
    days = order_facts.enrolment(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return columns.with_date_parts(days)


@query(
    "month_start",
    shown("SELECT CAST(date_trunc('month', date) AS DATE) AS date, count(*) AS n FROM enrol GROUP BY 1", whole="n", ctes=ENROL),
)
def _(spark, sf_dir):
    enrolled = order_facts.enrolment(spark, sf_dir)
    return enrolled.groupBy(columns.period_start("date", "M").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "future_calendar",
    shown(
        """SELECT state, step, CAST(date_trunc('month', last) + to_months(CAST(step AS INTEGER)) AS DATE) AS date,
        last_day(CAST(date_trunc('month', last) + to_months(CAST(step AS INTEGER)) AS DATE)) AS month_end
        FROM (SELECT state, max(date) AS last FROM enrol GROUP BY 1) CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS step)""",
        whole="step", dates="date month_end", ctes=ENROL,
    ),
)
def _(spark, sf_dir):
    last = order_facts.enrolment(spark, sf_dir).groupBy("state").agg(F.max("date").alias("last"))
    ahead = columns.explode_future(last, "last", 12)
    return ahead.select("state", "step", "date", F.last_day("date").alias("month_end"))


@query(
    "safe_ratios",
    shown(
        "SELECT date, state, CASE WHEN age_5_17 > 0 THEN CAST(bio_age_17_ AS DOUBLE) / age_5_17 ELSE 0 END AS zero_default, "
        "CASE WHEN age_5_17 > 0 THEN CAST(bio_age_17_ AS DOUBLE) / age_5_17 END AS null_default FROM merged",
        floats="zero_default null_default", ctes=joined(FACTS, monthly("state")),
    ),
)
def _(spark, sf_dir):
    merged = pipelines.monthly_panel(order_facts.activity(spark, sf_dir))
    return merged.select(
        "date", "state",
        columns.safe_divide("bio_age_17_", "age_5_17", 0).alias("zero_default"),
        columns.safe_divide("bio_age_17_", "age_5_17").alias("null_default"),
    )


# --- files -----------------------------------------------------------------


def _fact_totals(facts: dict[str, DataFrame]) -> DataFrame:
    """(fact, rows, first_date, last_date, total) of each fact."""
    out = None
    for fact, df in facts.items():
        measures = [F.col(c).cast("long") for c in df.columns if "age_" in c]
        one = df.agg(
            F.lit(fact).alias("fact"), F.count(F.lit(1)).alias("rows"), F.min("date").cast("string").alias("first_date"),
            F.max("date").cast("string").alias("last_date"), F.sum(sum(measures[1:], measures[0])).alias("total"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def _fact_totals_sql() -> str:
    parts = [
        f"SELECT '{RAW_NAMES[f]}' AS fact, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, "
        f"sum({' + '.join(MEASURE_NAMES[f])}) AS total FROM {f}"
        for f in MEASURE_NAMES
    ]
    return " UNION ALL ".join(parts)


@query("load_datasets", shown(_fact_totals_sql(), whole="rows total", dates="first_date last_date", ctes=FACTS))
def _(spark, sf_dir):
    folder = stage_path(spark, "datasets")
    for fact, df in order_facts.facts(spark, sf_dir).items():
        files.save_csv(df, f"{folder}/{files.FACT_FILES[fact]}")
    return _fact_totals(files.load_datasets(spark, folder))


@query(
    "load_csv_folder",
    shown(f"SELECT state, count(*) AS n, {sums(ENROL_NAMES)} FROM enrol GROUP BY 1", whole=f"n {ENROL_TEXT}", dates="", ctes=ENROL),
)
def _(spark, sf_dir):
    folder = stage_path(spark, "folder")
    enrolled = order_facts.enrolment(spark, sf_dir)
    old = F.col("date") < F.lit("1998-01-01").cast("date")
    files.save_csv(enrolled.where(old), f"{folder}/a.csv")
    files.save_csv(enrolled.where(~old).select(*reversed(enrolled.columns)), f"{folder}/b.csv")
    loaded = files.load_csv_folder(spark, folder)
    return loaded.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(m).cast("long")).alias(m) for m in ENROL_NAMES]
    )


@query("load_checked_facts", shown(_fact_totals_sql(), whole="rows total", dates="first_date last_date", ctes=FACTS))
def _(spark, sf_dir):
    folder = stage_path(spark, "export")
    for fact, df in order_facts.facts(spark, sf_dir).items():
        files.save_csv(df, f"{folder}/export_{fact}/part.csv")
    return _fact_totals(
        {
            "enrolment": files.load_enrolment(spark, folder),
            "demographic": files.load_demographic(spark, folder),
            "biometric": files.load_biometric(spark, folder),
        }
    )


@query(
    "saved_clean_csv",
    shown("SELECT * FROM clean_enrol", floats=ENROL_TEXT, ctes=joined(RAW_ENROL, clean_sql("enrol"))),
)
def _(spark, sf_dir):
    clean = cleaning.clean_fact(raw_fact(spark, sf_dir, "enrolment"), "enrolment")
    path = files.save_csv(clean.withColumn("state", F.trim("state")).withColumn("district", F.trim("district")), stage_path(spark, "csv"), order_by=["date"])
    loaded = files.load_csv_stage(spark, path, clean_schema("enrolment"))
    return loaded.withColumn("state", F.concat(F.lit("  "), "state", F.lit(" "))).withColumn("district", F.concat(F.lit(" "), "district"))


@query(
    "stage_handoff",
    shown("SELECT * FROM districts", floats=BASE_FLOATS, whole=f"{MEASURES_TEXT} {TOTALS_TEXT}", ctes=DISTRICTS),
)
def _(spark, sf_dir):
    stage = districts(spark, sf_dir)
    path = files.save_by_month(stage, stage_path(spark, "indicators"))
    return files.load_stage(spark, path).drop("month")


@query(
    "stage_reload",
    shown("SELECT * FROM panel", floats=PANEL_FLOATS, whole=f"{MEASURES_TEXT} {TOTALS_TEXT}", ctes=PANEL),
)
def _(spark, sf_dir):
    path = files.save_by_month(panel(spark, sf_dir), stage_path(spark, "panel"))
    return files.load_stage(spark, path).drop("month")


@query(
    "stage_reload_one_year",
    shown("SELECT * FROM panel WHERE year(date) = 1997", floats=PANEL_FLOATS, whole=f"{MEASURES_TEXT} {TOTALS_TEXT}", ctes=PANEL),
)
def _(spark, sf_dir):
    path = files.save_by_month(panel(spark, sf_dir), stage_path(spark, "panel"))
    return files.load_stage(spark, path).where("month BETWEEN '1997-01' AND '1997-12'").drop("month")


# --- pipelines -------------------------------------------------------------

BASE_PIPELINE = joined(
    FACTS,
    *[raw_sql(f) for f in MEASURE_NAMES],
    *[standard_sql(f) for f in MEASURE_NAMES],
    *[
        f"{f}_sum AS (SELECT date, state, district, pincode, {', '.join(f'sum(coalesce({m}, 0)) AS {m}' for m in MEASURE_NAMES[f])} "
        f"FROM std_{f} WHERE {COMPLETE} GROUP BY ALL)"
        for f in MEASURE_NAMES
    ],
    outer_joined("date, state, district, pincode", "_sum"),
)


@query("base_pipeline", shown("SELECT * FROM unified", floats=MEASURES_TEXT, ctes=BASE_PIPELINE))
def _(spark, sf_dir):
    raw = {f: raw_fact(spark, sf_dir, f, messy_names=True) for f in RAW_NAMES.values()}
    return pipelines.preprocess_all(raw)


def _monthly_pipeline(key: str) -> str:
    clean = [
        f"{f}_clean AS (SELECT * FROM clean_{f}{' WHERE state IS NOT NULL' if key else ''})" for f in MEASURE_NAMES
    ]
    sums_of = [
        f"{f}_sum AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date{', ' + key if key else ''}, "
        f"{', '.join(f'sum({m}) AS {m}' for m in MEASURE_NAMES[f])} FROM {f}_clean GROUP BY ALL)"
        for f in MEASURE_NAMES
    ]
    keys = "date, state" if key else "date"
    return joined(
        FACTS, *[raw_sql(f) for f in MEASURE_NAMES], *[clean_sql(f) for f in MEASURE_NAMES], *clean, *sums_of,
        *[dense(f, key) for f in MEASURE_NAMES], outer_joined(keys, "_dense", "merged"),
    )


for _level, _key in (("state", "state"), ("national", "")):

    @query(f"monthly_pipeline_{_level}", shown("SELECT * FROM merged", floats=MEASURES_TEXT, ctes=_monthly_pipeline(_key)))
    def _(spark, sf_dir, level=_level):
        raw = {f: raw_fact(spark, sf_dir, f) for f in RAW_NAMES.values()}
        return pipelines.monthly_panel(pipelines.clean_monthly(raw), level)


@query(
    "monthly_pipeline_both",
    shown(
        f"SELECT *, 'State' AS level FROM merged UNION ALL "
        f"SELECT date, 'All' AS state, {', '.join(f'sum({m})' for m in MEASURES)}, 'National' FROM merged GROUP BY date",
        whole=MEASURES_TEXT, ctes=joined(FACTS, monthly("state")),
    ),
)
def _(spark, sf_dir):
    return pipelines.monthly_panel(order_facts.activity(spark, sf_dir), "both")


@query(
    "concatenated_files",
    shown(
        f"SELECT fact, count(*) AS n, {sums(MEASURES)} FROM (SELECT 'enrolment' AS fact, * FROM enrol UNION ALL BY NAME "
        "SELECT 'demographic' AS fact, * FROM demo UNION ALL BY NAME SELECT 'biometric' AS fact, * FROM bio) GROUP BY 1",
        whole=f"n {MEASURES_TEXT}", dates="", ctes=FACTS,
    ),
)
def _(spark, sf_dir):
    out = None
    for fact, df in order_facts.facts(spark, sf_dir).items():
        rows = df.withColumn("fact", F.lit(fact))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in MEASURES])
