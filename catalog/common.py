"""Registry of the checked queries and the SQL parts their checks share.

Outputs follow one form on both sides: dates as text, floats rounded to six digits, whole
numbers as BIGINT, nulls in place of NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyworks.operators.forecast import select
from tallyworks.plans import pipelines
from tallyworks.sources import order_facts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def presented(df: DataFrame) -> DataFrame:
    """``df`` in the form the checks compare."""

    def form(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, WHOLE):
            c = c.cast("long")
        return c.alias(f.name)

    return df.select(*[form(f) for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL check if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, sf_dir: presented(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def shown(body: str, floats: str = "", whole: str = "", dates: str = "date", ctes: str = "") -> str:
    """SELECT over ``body`` with the columns named by kind brought to the compared form."""
    parts = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in floats.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()]
    parts += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT *{replace} FROM ({body}) AS result"


def joined(*ctes: str) -> str:
    return ", ".join(ctes)


# --- the three facts -------------------------------------------------------

_PLACE = "n_name AS state, c_mktsegment AS district, CAST(100000 + c_custkey % 20 AS VARCHAR) AS pincode"
_CUSTOMER = "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

ENROL = f"""enrol AS (
  SELECT CAST(o_orderdate AS DATE) AS date, {_PLACE},
    CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS BIGINT) AS age_0_5,
    CAST(o_orderpriority = '3-MEDIUM' AS BIGINT) AS age_5_17,
    CAST(o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS BIGINT) AS age_18_greater
  FROM orders {_CUSTOMER})"""


def _update(name: str, flag: str, parity: int, young: str, adult: str) -> str:
    return f"""{name} AS (
  SELECT CAST(l_shipdate AS DATE) AS date, {_PLACE},
    CAST(l_linestatus = 'F' AS BIGINT) AS {young}, CAST(l_linestatus = 'O' AS BIGINT) AS {adult}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey {_CUSTOMER} WHERE l_returnflag = '{flag}' OR l_returnflag = 'N' AND l_orderkey % 2 = {parity})"""


DEMO = _update("demo", "R", 1, "demo_age_5_17", "demo_age_17_")
BIO = _update("bio", "A", 0, "bio_age_5_17", "bio_age_17_")
FACTS = joined(ENROL, DEMO, BIO)

MEASURE_NAMES = {
    "enrol": ["age_0_5", "age_5_17", "age_18_greater"],
    "demo": ["demo_age_5_17", "demo_age_17_"],
    "bio": ["bio_age_5_17", "bio_age_17_"],
}
MEASURES = [m for names in MEASURE_NAMES.values() for m in names]
MEASURES_TEXT = " ".join(MEASURES)


def sums(names: list[str]) -> str:
    return ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in names)


def grouped(fact: str, keys: str, date: str = "date", name: str | None = None) -> str:
    """CTE ``<fact>_sum``: the fact summed per key, dates truncated to ``date``."""
    when = "date" if date == "date" else f"CAST(date_trunc('{date}', date) AS DATE) AS date"
    columns = ", ".join([when, *[k for k in keys.split(", ") if k and k != "date"]])
    return f"{name or fact + '_sum'} AS (SELECT {columns}, {sums(MEASURE_NAMES[fact])} FROM {fact} GROUP BY ALL)"


def outer_joined(keys: str, suffix: str, name: str = "unified") -> str:
    filled = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES)
    return (
        f"{name} AS (SELECT {keys}, {filled} FROM enrol{suffix} "
        f"FULL JOIN demo{suffix} USING ({keys}) FULL JOIN bio{suffix} USING ({keys}))"
    )


def dense(fact: str, key: str = "state") -> str:
    """CTE ``<fact>_dense``: a month spine from the fact's first to last month for all its keys."""
    filled = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURE_NAMES[fact])
    months = f"(SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM {fact}_sum)"
    if key:
        spine = f"{months} CROSS JOIN (SELECT DISTINCT {key} FROM {fact}_sum)"
        return f"{fact}_dense AS (SELECT date, {key}, {filled} FROM {spine} LEFT JOIN {fact}_sum USING (date, {key}))"
    return f"{fact}_dense AS (SELECT date, {filled} FROM {months} LEFT JOIN {fact}_sum USING (date))"


def monthly(key: str = "state", name: str = "merged") -> str:
    keys = ", ".join(k for k in ["date", key] if k)
    parts = [grouped(f, key, "month") for f in MEASURE_NAMES] + [dense(f, key) for f in MEASURE_NAMES]
    return joined(*parts, outer_joined(keys, "_dense", name))


def ratio(num: str, den: str, default: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE {default} END"


def growth(c: str, keys: str, order: str = "date") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    prev = f"lag({c}) OVER ({part}ORDER BY {order})"
    return f"CASE WHEN {prev} <> 0 THEN (CAST({c} AS DOUBLE) - {prev}) / {prev} * 100 END"


def with_panel_indicators(source: str, name: str, keys: str) -> str:
    """Indicators of the monthly line."""
    return f"""{name}_totals AS (SELECT *, age_0_5 + age_5_17 + age_18_greater AS total_enrolment,
    demo_age_5_17 + demo_age_17_ AS total_demo_updates, bio_age_5_17 + bio_age_17_ AS total_bio_updates,
    demo_age_5_17 + demo_age_17_ + bio_age_5_17 + bio_age_17_ AS total_updates FROM {source}),
  {name} AS (SELECT *, {ratio('total_updates', 'total_enrolment', '0')} AS service_workload,
    {ratio('total_updates', 'total_enrolment', '0')} AS update_pressure_index,
    {ratio('bio_age_17_', 'age_5_17', '0')} AS youth_update_rate,
    {ratio('bio_age_17_', 'age_5_17', '0')} AS age_transition_rate,
    {growth('total_enrolment', keys)} AS enrolment_growth_rate, {growth('total_updates', keys)} AS update_growth_rate,
    {ratio('total_bio_updates', 'total_demo_updates', '0')} AS bio_demo_ratio,
    {ratio('(age_0_5 + age_5_17)', 'total_enrolment', '0')} * 100 AS child_share,
    {ratio('(age_0_5 + age_5_17)', 'total_enrolment', '0')} * 100 AS child_enrolment_share
  FROM {name}_totals)"""


TOTALS_TEXT = "total_enrolment total_demo_updates total_bio_updates total_updates"
PANEL_FLOATS = (
    "service_workload update_pressure_index youth_update_rate age_transition_rate enrolment_growth_rate "
    "update_growth_rate bio_demo_ratio child_share child_enrolment_share"
)
# The dense monthly state panel with its indicators.
PANEL = joined(FACTS, monthly("state"), with_panel_indicators("merged", "panel", "state"))

BASE_FLOATS = "update_pressure_index age_transition_rate demo_bio_ratio total_enrolment_growth total_updates_growth"


def with_base_indicators(source: str, name: str, keys: str = "state, district", order: str = "date") -> str:
    """Indicators of the base line."""
    return f"""{name}_totals AS (SELECT *, age_0_5 + age_5_17 + age_18_greater AS total_enrolment,
    demo_age_5_17 + demo_age_17_ AS total_demo_updates, bio_age_5_17 + bio_age_17_ AS total_bio_updates,
    demo_age_5_17 + demo_age_17_ + bio_age_5_17 + bio_age_17_ AS total_updates FROM {source}),
  {name} AS (SELECT *, {ratio('total_updates', 'total_enrolment', '0')} AS update_pressure_index,
    {ratio('bio_age_17_', 'age_5_17', '0')} AS age_transition_rate,
    {ratio('total_demo_updates', 'total_bio_updates', 'NULL')} AS demo_bio_ratio,
    {growth('total_enrolment', keys, order)} AS total_enrolment_growth,
    {growth('total_updates', keys, order)} AS total_updates_growth
  FROM {name}_totals)"""


# The base line by month, state and district.
DISTRICTS = joined(
    FACTS,
    *[grouped(f, "state, district", "month") for f in MEASURE_NAMES],
    outer_joined("date, state, district", "_sum", "district_sums"),
    with_base_indicators("district_sums", "districts"),
)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.indicator_panel(order_facts.activity(spark, sf_dir))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.district_panel(order_facts.activity(spark, sf_dir))


HEADLINE = ["total_enrolment", "total_updates", "update_pressure_index"]


def unpivoted(source: str, ids: str, metrics: list[str], name: str = "long") -> str:
    parts = [f"SELECT {ids}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


SERIES_METRICS = select.FORECAST_METRICS
# (level, state, metric, date, value): the nation and every state.
SERIES = joined(
    PANEL,
    unpivoted("panel", "date, state", SERIES_METRICS, "panel_long"),
    """series AS (
  SELECT 'State' AS level, state, metric, date, sum(value) AS value FROM panel_long GROUP BY ALL
  UNION ALL SELECT 'National', 'All', metric, date, sum(value) FROM panel_long GROUP BY ALL)""",
)
SERIES_KEYS = select.SERIES_KEYS


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.metric_series(panel(spark, sf_dir), SERIES_METRICS)
