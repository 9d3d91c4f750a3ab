"""Roll-ups, joins, series, filters and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    BASE_FLOATS, DISTRICTS, ENROL, FACTS, HEADLINE, MEASURE_NAMES, MEASURES, MEASURES_TEXT, PANEL, PANEL_FLOATS,
    SERIES, TOTALS_TEXT, districts, grouped, growth, joined, monthly, outer_joined, panel, query, ratio,
    series, shown, sums, unpivoted, with_base_indicators,
)
from tallyworks.functions.lineage import materialise
from tallyworks.operators import filters, indicators, panel as ops
from tallyworks.operators.stats import long_form
from tallyworks.plans import pipelines
from tallyworks.sources import order_facts

ENROL_NAMES = MEASURE_NAMES["enrol"]
ENROL_TEXT = " ".join(ENROL_NAMES)
DAILY = [grouped(f, "state, district, pincode") for f in MEASURE_NAMES]
KEYS4 = "date, state, district, pincode"

# --- roll-ups --------------------------------------------------------------


@query("aggregate_by_district", shown("SELECT * FROM enrol_sum", whole=ENROL_TEXT, ctes=joined(ENROL, grouped("enrol", "state, district"))))
def _(spark, sf_dir):
    return ops.aggregate(order_facts.enrolment(spark, sf_dir))


@query("aggregate_to_month", shown("SELECT * FROM enrol_sum", whole=ENROL_TEXT, ctes=joined(ENROL, grouped("enrol", "state", "month"))))
def _(spark, sf_dir):
    return ops.aggregate_to_month(order_facts.enrolment(spark, sf_dir), ["state"], ENROL_NAMES)


@query(
    "national_aggregate",
    shown("SELECT *, 'National' AS level FROM enrol_sum", whole=ENROL_TEXT, ctes=joined(ENROL, grouped("enrol", "", "month"))),
)
def _(spark, sf_dir):
    by_state = ops.aggregate_to_month(order_facts.enrolment(spark, sf_dir), ["state"], ENROL_NAMES)
    return ops.national_aggregate(by_state)


@query(
    "state_aggregate",
    shown("SELECT *, 'State' AS level FROM enrol_sum", whole=ENROL_TEXT, ctes=joined(ENROL, grouped("enrol", "state", "month"))),
)
def _(spark, sf_dir):
    by_district = ops.aggregate_to_month(order_facts.enrolment(spark, sf_dir), ["state", "district"], ENROL_NAMES)
    return ops.state_aggregate(by_district)


@query(
    "both_levels",
    shown(
        f"SELECT *, 'State' AS level FROM enrol_sum UNION ALL BY NAME "
        f"SELECT date, 'National' AS level, {sums(ENROL_NAMES)} FROM enrol_sum GROUP BY date",
        whole=ENROL_TEXT, ctes=joined(ENROL, grouped("enrol", "state", "month")),
    ),
)
def _(spark, sf_dir):
    return ops.both_levels(ops.aggregate_to_month(order_facts.enrolment(spark, sf_dir), ["state"], ENROL_NAMES))


@query(
    "monthly_all_measures",
    shown(
        f"SELECT CAST(date_trunc('month', date) AS DATE) AS date, {sums(MEASURES + TOTALS_TEXT.split())}, "
        "sum(update_pressure_index) AS update_pressure_index, sum(age_transition_rate) AS age_transition_rate, "
        "sum(demo_bio_ratio) AS demo_bio_ratio, sum(total_enrolment_growth) AS total_enrolment_growth, "
        "sum(total_updates_growth) AS total_updates_growth FROM districts GROUP BY 1",
        floats=BASE_FLOATS, whole=f"{MEASURES_TEXT} {TOTALS_TEXT}", ctes=DISTRICTS,
    ),
)
def _(spark, sf_dir):
    return ops.aggregate_to_month(districts(spark, sf_dir))


@query(
    "data_summary",
    shown(
        "SELECT 'Enrolment' AS name, 7 AS columns, count(*) AS rows, 0 AS missing_values, min(date) AS first_date, "
        "max(date) AS last_date, count(DISTINCT state) AS states, count(DISTINCT district) AS districts FROM enrol",
        whole="columns rows missing_values states districts", dates="first_date last_date", ctes=ENROL,
    ),
)
def _(spark, sf_dir):
    return ops.data_summary(order_facts.enrolment(spark, sf_dir), "Enrolment")


# --- joins -----------------------------------------------------------------

UNIFIED = joined(FACTS, *DAILY, outer_joined(KEYS4, "_sum"))


@query("unified_table", shown("SELECT * FROM unified", whole=MEASURES_TEXT, ctes=UNIFIED))
def _(spark, sf_dir):
    return ops.unify(ops.stack_facts(order_facts.facts(spark, sf_dir)))


@query("unified_by_outer_join", shown("SELECT * FROM unified", whole=MEASURES_TEXT, ctes=UNIFIED))
def _(spark, sf_dir):
    keys = KEYS4.split(", ")
    facts = [ops.aggregate(df, keys) for df in order_facts.facts(spark, sf_dir).values()]
    return ops.join_facts(facts, keys)


@query(
    "joined_with_clashing_names",
    shown(
        "SELECT state, district, coalesce(e.n, 0) AS n, coalesce(d.n, 0) AS n_demo, coalesce(b.n, 0) AS n_bio "
        "FROM (SELECT state, district, count(*) AS n FROM enrol GROUP BY ALL) e FULL JOIN "
        "(SELECT state, district, count(*) AS n FROM demo GROUP BY ALL) d USING (state, district) FULL JOIN "
        "(SELECT state, district, count(*) AS n FROM bio GROUP BY ALL) b USING (state, district)",
        whole="n n_demo n_bio", dates="", ctes=FACTS,
    ),
)
def _(spark, sf_dir):
    keys = ["state", "district"]
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for df in order_facts.facts(spark, sf_dir).values()]
    return ops.join_facts(counts, keys)


@query("merged_state_months", shown("SELECT * FROM merged", whole=MEASURES_TEXT, ctes=joined(FACTS, monthly("state"))))
def _(spark, sf_dir):
    return pipelines.monthly_panel(order_facts.activity(spark, sf_dir), "state")


@query("merged_national_months", shown("SELECT * FROM merged", whole=MEASURES_TEXT, ctes=joined(FACTS, monthly(""))))
def _(spark, sf_dir):
    facts = order_facts.facts(spark, sf_dir)
    filled = [ops.fill_missing_months(ops.aggregate_to_month(df, measures=MEASURE_NAMES[k])) for k, df in zip(MEASURE_NAMES, facts.values())]
    return ops.join_facts(filled, ["date"])


@query(
    "month_spine",
    shown("SELECT * FROM enrol_dense", whole=ENROL_TEXT, ctes=joined(FACTS, monthly("state"))),
)
def _(spark, sf_dir):
    by_state = ops.aggregate_to_month(order_facts.enrolment(spark, sf_dir), ["state"], ENROL_NAMES)
    return ops.fill_missing_months(materialise(by_state), ["state"])


POPULATION = "pop AS (SELECT n_name AS state, c_mktsegment AS district, count(*) * 1000 AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


@query(
    "coverage",
    shown(
        "SELECT date, state, district, total_enrolment, population, CAST(total_enrolment AS DOUBLE) / population * 100 AS coverage_rate "
        "FROM districts LEFT JOIN pop USING (state, district)",
        floats="coverage_rate", whole="total_enrolment population", ctes=joined(DISTRICTS, POPULATION),
    ),
)
def _(spark, sf_dir):
    covered = indicators.coverage(districts(spark, sf_dir), order_facts.population(spark, sf_dir))
    return covered.select("date", "state", "district", "total_enrolment", "population", "coverage_rate")


# --- series ----------------------------------------------------------------


def _prepared(how: str, freq: str, source: str, value: str, key: str) -> str:
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[freq]
    step = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}[freq]
    f = {"sum": "sum", "mean": "avg", "median": "median"}[how]
    points = (
        f"points AS (SELECT {key}, CAST(date_trunc('{unit}', date) AS DATE) AS p, {f}(CAST({value} AS DOUBLE)) AS v "
        f"FROM {source} GROUP BY ALL)"
    )
    spine = (
        f"spine AS (SELECT {key}, CAST(unnest(generate_series(min(p), max(p), INTERVAL '{step}')) AS DATE) AS p "
        f"FROM points GROUP BY {key})"
    )
    filled = (
        "coalesce(v, 0)"
        if how == "sum"
        else f"coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY p ROWS UNBOUNDED PRECEDING), "
        f"first_value(v IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )
    end = f"CAST(p + INTERVAL '{step}' - INTERVAL '1 day' AS DATE)"
    return joined(points, spine, f"prepared AS (SELECT {key}, {end} AS date, {filled} AS value FROM spine LEFT JOIN points USING ({key}, p))")


SERIES_QUERIES = [
    ("monthly_sum", "enrol", "age_0_5", "state", "M", "sum"),
    ("daily_mean", "enrol", "age_0_5", "state", "D", "mean"),
    ("quarterly_sum", "bio", "bio_age_17_", "district", "Q", "sum"),
    ("yearly_mean", "demo", "demo_age_17_", "state", "Y", "mean"),
]
FACT_OF = {"enrol": order_facts.enrolment, "demo": order_facts.demographic, "bio": order_facts.biometric}
for _name, _fact, _value, _key, _freq, _how in SERIES_QUERIES:

    @query(f"series_{_name}", shown("SELECT * FROM prepared", floats="value", ctes=joined(FACTS, _prepared(_how, _freq, _fact, _value, _key))))
    def _(spark, sf_dir, fact=_fact, value=_value, key=_key, freq=_freq, how=_how):
        return ops.prepare_series(FACT_OF[fact](spark, sf_dir), value, [key], freq, how)


EVENTS = "days AS (SELECT CAST(ts AS DATE) AS date, event_type AS state, value FROM events)"


@query("series_weekly_median", shown("SELECT * FROM prepared", floats="value", ctes=joined(EVENTS, _prepared("median", "W", "days", "value", "state"))))
def _(spark, sf_dir):
    return ops.prepare_series(order_facts.event_series(spark, sf_dir), "value", ["state"], "W", "median")


@query(
    "filled_both_ways",
    shown(
        """SELECT state, date, coalesce(
          last_value(v IGNORE NULLS) OVER (PARTITION BY state ORDER BY date ROWS UNBOUNDED PRECEDING),
          first_value(v IGNORE NULLS) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
        FROM (SELECT state, date, CASE WHEN age_5_17 > 3 THEN CAST(age_5_17 AS DOUBLE) END AS v FROM panel)""",
        floats="value", ctes=PANEL,
    ),
)
def _(spark, sf_dir):
    gaps = panel(spark, sf_dir).select("state", "date", F.when(F.col("age_5_17") > 3, F.col("age_5_17").cast("double")).alias("value"))
    return ops.fill_both_ways(gaps, "value", ["state"], "date")


# --- filters ---------------------------------------------------------------

SHORT = "date, state, district, total_enrolment, total_updates"


@query(
    "filtered_rows",
    shown(
        f"SELECT {SHORT} FROM districts WHERE date BETWEEN DATE '1996-03-01' AND DATE '1999-02-01' AND state = 'NATION_3' AND district = 'BUILDING'",
        whole="total_enrolment total_updates", ctes=DISTRICTS,
    ),
)
def _(spark, sf_dir):
    rows = filters.filter_data(districts(spark, sf_dir), ("1996-03-01", "1999-02-01"), "NATION_3", "BUILDING")
    return rows.select(*SHORT.split(", "))


@query("unfiltered_rows", shown(f"SELECT {SHORT} FROM districts", whole="total_enrolment total_updates", ctes=DISTRICTS))
def _(spark, sf_dir):
    return filters.filter_data(districts(spark, sf_dir)).select(*SHORT.split(", "))


@query(
    "state_slice",
    shown("SELECT * FROM panel WHERE state = 'NATION_7'", floats=PANEL_FLOATS, whole=f"{MEASURES_TEXT} {TOTALS_TEXT}", ctes=PANEL),
)
def _(spark, sf_dir):
    return filters.filter_data(panel(spark, sf_dir), state="NATION_7")


@query(
    "history_status",
    shown(
        """SELECT DISTINCT state, district, n_months, CASE WHEN n_months < 70 THEN 'too short' WHEN n_months < 76 THEN 'trend only'
          ELSE 'seasonal' END AS status FROM (SELECT state, district, count(*) OVER (PARTITION BY state, district) AS n_months
          FROM districts WHERE total_enrolment > 0)""",
        whole="n_months", dates="", ctes=DISTRICTS,
    ),
)
def _(spark, sf_dir):
    active = districts(spark, sf_dir).where("total_enrolment > 0")
    guarded = filters.history_status(active, ["state", "district"], 70, 76)
    return guarded.select("state", "district", "n_months", "status").distinct()


@query(
    "filter_choices",
    shown(
        """SELECT 'first_date' AS kind, CAST(min(date) AS VARCHAR) AS choice FROM districts
        UNION ALL SELECT 'last_date', CAST(max(date) AS VARCHAR) FROM districts
        UNION ALL SELECT DISTINCT 'state', state FROM districts
        UNION ALL SELECT DISTINCT 'district', district FROM districts WHERE state = 'NATION_2'""",
        dates="", ctes=DISTRICTS,
    ),
)
def _(spark, sf_dir):
    return filters.filter_choices(districts(spark, sf_dir), "NATION_2")


# --- indicators ------------------------------------------------------------

WHOLE = f"{MEASURES_TEXT} {TOTALS_TEXT}"


def _merged(spark, sf_dir):
    return pipelines.monthly_panel(order_facts.activity(spark, sf_dir))


def _indicator(name: str, sql_columns: str, floats: str, whole: str, columns: list[str], step) -> None:
    """One indicator on the merged panel."""

    @query(name, shown(f"SELECT date, state, {sql_columns} FROM panel", floats=floats, whole=whole, ctes=PANEL))
    def _(spark, sf_dir):
        return step(_merged(spark, sf_dir)).select("date", "state", *columns)


UPDATES = ["total_demo_updates", "total_bio_updates", "total_updates"]
_indicator("total_enrolment", "total_enrolment", "", "total_enrolment", ["total_enrolment"], indicators.total_enrolment)
_indicator("total_updates", ", ".join(UPDATES), "", " ".join(UPDATES), UPDATES, indicators.total_updates)
_indicator(
    "total_enrolment_unknown_if_part_is", "total_enrolment", "", "total_enrolment", ["total_enrolment"],
    lambda df: indicators.total_enrolment(df, skip_nulls=False),
)
_indicator(
    "total_demographic_updates", "total_demo_updates", "", "total_demo_updates", ["total_demo_updates"],
    lambda df: indicators.total_demographic_updates(df, skip_nulls=False),
)
_indicator(
    "total_biometric_updates", "total_bio_updates", "", "total_bio_updates", ["total_bio_updates"],
    lambda df: indicators.total_biometric_updates(df, skip_nulls=False),
)
_indicator(
    "total_updates_unknown_if_part_is", "total_updates", "", "total_updates", ["total_updates"],
    lambda df: indicators.total_updates(df, skip_nulls=False),
)
# The panel with bands that are not known in some months.
GAPS = {"age_5_17": 3, "demo_age_17_": 4, "bio_age_5_17": 5}
_GAPPED = ", ".join(f"CASE WHEN month(date) % {k} = 0 THEN NULL ELSE {m} END AS {m}" for m, k in GAPS.items())


def _gapped(spark, sf_dir):
    return _merged(spark, sf_dir).withColumns({m: F.when(F.month("date") % k != 0, F.col(m)) for m, k in GAPS.items()})


def _with_gaps(name: str, enrolment: str, demographic: str, biometric: str, skip_nulls: bool) -> None:
    totals = f"{enrolment} AS total_enrolment, {demographic} AS total_demo_updates, {biometric} AS total_bio_updates"

    @query(
        name,
        shown(
            f"SELECT *, total_demo_updates + total_bio_updates AS total_updates FROM (SELECT date, state, {totals} FROM (SELECT * REPLACE ({_GAPPED}) FROM panel))",
            whole=TOTALS_TEXT, ctes=PANEL,
        ),
    )
    def _(spark, sf_dir):
        found = indicators.total_updates(indicators.total_enrolment(_gapped(spark, sf_dir), skip_nulls), skip_nulls)
        return found.select("date", "state", *TOTALS_TEXT.split())


_with_gaps("totals_unknown_where_a_band_is", "age_0_5 + age_5_17 + age_18_greater", "demo_age_5_17 + demo_age_17_", "bio_age_5_17 + bio_age_17_", False)
_with_gaps(
    "totals_of_the_known_bands", "age_0_5 + coalesce(age_5_17, 0) + age_18_greater", "demo_age_5_17 + coalesce(demo_age_17_, 0)",
    "coalesce(bio_age_5_17, 0) + bio_age_17_", True,
)
_indicator(
    "update_pressure_index", "update_pressure_index", "update_pressure_index", "", ["update_pressure_index"],
    indicators.update_pressure_index,
)
_indicator("service_workload", "service_workload", "service_workload", "", ["service_workload"], indicators.service_workload)
_indicator(
    "age_transition_rate", "age_transition_rate", "age_transition_rate", "", ["age_transition_rate"], indicators.age_transition_rate
)
_indicator("youth_update_rate", "youth_update_rate", "youth_update_rate", "", ["youth_update_rate"], indicators.youth_update_rate)
_indicator(
    "demo_bio_ratio", f"{ratio('total_demo_updates', 'total_bio_updates', 'NULL')} AS demo_bio_ratio", "demo_bio_ratio", "",
    ["demo_bio_ratio"], indicators.demo_bio_ratio,
)
_indicator("bio_demo_ratio", "bio_demo_ratio", "bio_demo_ratio", "", ["bio_demo_ratio"], indicators.bio_demo_ratio)
_indicator("child_share", "child_share", "child_share", "", ["child_share"], indicators.child_share)
_indicator(
    "workload_class",
    "CASE WHEN service_workload < 1 THEN 'Low' WHEN service_workload < 2 THEN 'Normal' WHEN service_workload < 5 THEN 'High' ELSE 'Very High' END AS class",
    "", "", ["class"], lambda df: indicators.service_workload(df).withColumn("class", indicators.workload_class()),
)
_indicator(
    "update_pressure_class",
    "CASE WHEN total_bio_updates = 0 THEN 'Unknown' WHEN CAST(total_demo_updates AS DOUBLE) / total_bio_updates < 1 THEN 'Low' "
    "WHEN CAST(total_demo_updates AS DOUBLE) / total_bio_updates < 2 THEN 'Normal' "
    "WHEN CAST(total_demo_updates AS DOUBLE) / total_bio_updates < 5 THEN 'High' ELSE 'Very High' END AS class",
    "", "", ["class"], lambda df: indicators.demo_bio_ratio(df).withColumn("class", indicators.update_pressure_class("demo_bio_ratio")),
)
_indicator(
    "demand_level",
    "CASE WHEN bio_demo_ratio > 0.5 THEN 'High' WHEN bio_demo_ratio > 0.2 THEN 'Medium' ELSE 'Low' END AS demand",
    "", "", ["demand"], lambda df: indicators.bio_demo_ratio(df).withColumn("demand", indicators.demand_level("bio_demo_ratio")),
)
_indicator(
    "update_balance",
    "CASE WHEN bio_demo_ratio > 1.2 THEN 'more demographic' WHEN bio_demo_ratio < 0.8 THEN 'more biometric' ELSE 'balanced' END AS balance",
    "", "", ["balance"], lambda df: indicators.bio_demo_ratio(df).withColumn("balance", indicators.update_balance("bio_demo_ratio")),
)


@query("base_indicators", shown("SELECT * FROM districts", floats=BASE_FLOATS, whole=WHOLE, ctes=DISTRICTS))
def _(spark, sf_dir):
    return districts(spark, sf_dir)


@query("panel_indicators", shown("SELECT * FROM panel", floats=PANEL_FLOATS, whole=WHOLE, ctes=PANEL))
def _(spark, sf_dir):
    return panel(spark, sf_dir)


@query(
    "district_growth",
    shown("SELECT date, state, district, total_enrolment_growth, total_updates_growth FROM districts", floats="total_enrolment_growth total_updates_growth", ctes=DISTRICTS),
)
def _(spark, sf_dir):
    rows = order_facts.activity(spark, sf_dir).withColumn("date", F.trunc("date", "month"))
    totals = indicators.total_updates(indicators.total_enrolment(ops.unify(rows, ["date", "state", "district"])))
    return indicators.growth_rates(totals).select("date", "state", "district", "total_enrolment_growth", "total_updates_growth")


@query(
    "daily_growth",
    shown(
        "SELECT date, state, district, pincode, total_enrolment, total_updates, total_enrolment_growth, total_updates_growth FROM days",
        floats="total_enrolment_growth total_updates_growth", whole="total_enrolment total_updates",
        ctes=joined(UNIFIED, with_base_indicators("unified", "days", "state, district", "date, pincode")),
    ),
)
def _(spark, sf_dir):
    unified = ops.unify(order_facts.activity(spark, sf_dir))
    days = indicators.base_indicators(unified, order=["date", "pincode"], by_range=True)
    return days.select(
        "date", "state", "district", "pincode", "total_enrolment", "total_updates", "total_enrolment_growth", "total_updates_growth"
    )


@query(
    "enrolment_growth_rate",
    shown("SELECT date, state, enrolment_growth_rate FROM panel", floats="enrolment_growth_rate", ctes=PANEL),
)
def _(spark, sf_dir):
    grown = indicators.growth_rates(indicators.total_enrolment(_merged(spark, sf_dir), False), ["state"], metrics=["total_enrolment"])
    return grown.select("date", "state", F.col("total_enrolment_growth").alias("enrolment_growth_rate"))


@query(
    "update_growth_rate_across_states",
    shown(
        f"SELECT date, state, {growth('total_updates', '', 'date, state')} AS update_growth_rate FROM panel",
        floats="update_growth_rate", ctes=PANEL,
    ),
)
def _(spark, sf_dir):
    totals = indicators.total_updates(_merged(spark, sf_dir), False)
    grown = indicators.growth_rates(totals, [], ["date", "state"], ["total_updates"], by_range=True)
    return grown.select("date", "state", F.col("total_updates_growth").alias("update_growth_rate"))


@query(
    "national_growth",
    shown(
        f"SELECT date, {growth('total_enrolment', '')} AS enrolment_growth_rate, {growth('total_updates', '')} AS update_growth_rate "
        "FROM (SELECT date, sum(total_enrolment) AS total_enrolment, sum(total_updates) AS total_updates FROM panel GROUP BY 1)",
        floats="enrolment_growth_rate update_growth_rate", ctes=PANEL,
    ),
)
def _(spark, sf_dir):
    nation = pipelines.indicator_panel(order_facts.activity(spark, sf_dir), "national")
    return nation.select("date", "enrolment_growth_rate", "update_growth_rate")


@query(
    "long_form",
    shown("SELECT * FROM long", floats="value", ctes=joined(PANEL, unpivoted("panel", "date, state", HEADLINE))),
)
def _(spark, sf_dir):
    return long_form(panel(spark, sf_dir), ["date", "state"], HEADLINE)


@query("metric_series", shown("SELECT * FROM series", floats="value", ctes=SERIES))
def _(spark, sf_dir):
    return series(spark, sf_dir)
