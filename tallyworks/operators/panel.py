"""Roll-ups, the unified panel, month spines and time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from tallyworks.functions.columns import period_end, period_sequence, period_start
from tallyworks.functions.quantiles import exact_quantiles
from tallyworks.schemas import ALL_MEASURES, FACT_KEYS, MEASURES


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in but]


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a full key take part in no group."""
    return df.na.drop(subset=list(keys)) if keys else df


def aggregate(df: DataFrame, keys: Sequence[str] = ("date", "state", "district"), measures=None) -> DataFrame:
    """Sum of the measures (default: all numeric columns) per key."""
    measures = numeric_columns(df, but=keys) if measures is None else [m for m in measures if m in df.columns]
    if not measures:
        return df
    return drop_null_keys(df, keys).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def aggregate_to_month(df: DataFrame, keys: Sequence[str] = (), measures=None, date: str = "date") -> DataFrame:
    """Sum of the measures per month (labelled by its first day) and key."""
    measures = numeric_columns(df, but=keys) if measures is None else [m for m in measures if m in df.columns]
    month = drop_null_keys(df, [date, *keys]).withColumn(date, F.trunc(date, "month"))
    return month.groupBy(date, *keys).agg(*[F.sum(m).alias(m) for m in measures])


def national_aggregate(df: DataFrame, measures=None, date: str = "date") -> DataFrame:
    return aggregate(df, [date], measures).withColumn("level", F.lit("National"))


def state_aggregate(df: DataFrame, measures=None, date: str = "date", state: str = "state") -> DataFrame:
    return aggregate(df, [date, state], measures).withColumn("level", F.lit("State"))


def both_levels(df: DataFrame, measures=None, date: str = "date", state: str = "state") -> DataFrame:
    """National and state sums from one pass; the national rows have no state."""
    measures = numeric_columns(df) if measures is None else list(measures)
    sums = [F.sum(m).alias(m) for m in measures]
    return (
        drop_null_keys(df, [date, state])
        .groupingSets([[F.col(date)], [F.col(date), F.col(state)]], F.col(date), F.col(state))
        .agg(F.when(F.grouping(state) == 1, "National").otherwise("State").alias("level"), *sums)
    )


def stack_facts(facts: Mapping[str, DataFrame], keys: Sequence[str] = tuple(FACT_KEYS)) -> DataFrame:
    """All facts below each other, tagged, with 0 for the measures a fact does not have.

    One grouping of this frame gives what grouping every fact and full-outer-joining the
    results gives, with one shuffle in place of five.
    """
    out = None
    for fact, df in facts.items():
        own = MEASURES[fact]
        rows = df.select(
            *keys,
            F.lit(fact).alias("fact"),
            *[(F.coalesce(F.col(m), F.lit(0)) if m in own else F.lit(0)).cast(df.schema[own[0]].dataType).alias(m)
              for m in ALL_MEASURES],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def unify(activity: DataFrame, keys: Sequence[str] = tuple(FACT_KEYS), complete: bool = False) -> DataFrame:
    """The unified table: one row per key that any fact has, absent measures 0.

    ``complete`` says that no key is null, so it need not be tested.
    """
    rows = activity if complete else drop_null_keys(activity, keys)
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ALL_MEASURES if m in activity.columns])


def join_facts(facts: Sequence[DataFrame], keys: Sequence[str], suffixes: Sequence[str] = ("", "_demo", "_bio")) -> DataFrame:
    """Full outer join of facts already unique per key; absent measures 0.

    A measure name that is taken gets the fact's suffix. For facts that still need
    grouping, ``unify(stack_facts(...))`` is cheaper.
    """
    out = facts[0]
    for df, suffix in zip(facts[1:], suffixes[1:]):
        clash = {c: c + suffix for c in df.columns if c not in keys and c in out.columns}
        out = out.join(df.withColumnsRenamed(clash), list(keys), "full")
    return out.na.fill(0, numeric_columns(out, but=keys))


def fill_missing_months(df: DataFrame, keys: Sequence[str] = (), fill: float = 0, date: str = "date") -> DataFrame:
    """Every month between the first and the last for every key; new and null numbers get ``fill``.

    ``df`` holds one row per month and key, and is read more than once: pass a stage table.
    """
    span = df.agg(F.struct(F.min(date).alias("first"), F.max(date).alias("last")).alias("_span"))
    groups = df.select(*keys).distinct().withColumn("_span", span.scalar()) if keys else span
    months = period_sequence(F.col("_span.first"), F.col("_span.last"), "M")
    spine = groups.select(*keys, F.explode(months).alias(date))
    return spine.join(df, [date, *keys], "left").na.fill(fill, numeric_columns(df, but=keys))


def monthly_by_fact(activity: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    """Monthly sums over all facts, with the number of rows each fact gave (``n_<fact>``)."""
    rows = drop_null_keys(activity, ["date", *keys]).withColumn("date", F.trunc("date", "month"))
    return rows.groupBy("date", *keys).agg(
        *[F.sum(m).alias(m) for m in ALL_MEASURES],
        *[F.count_if(F.col("fact") == f).alias(f"n_{f}") for f in MEASURES],
    )


def densify(monthly: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    """Fill the months each fact lacks with 0 and merge the facts.

    A fact covers its own first to last month for the keys it knows, so the result holds
    the union of those. ``monthly`` is the stage table made from :func:`monthly_by_fact`.
    """
    has = {f: F.col(f"n_{f}") > 0 for f in MEASURES}
    span = monthly.agg(
        F.struct(
            *[F.min(F.when(h, F.col("date"))).alias(f"lo_{f}") for f, h in has.items()],
            *[F.max(F.when(h, F.col("date"))).alias(f"hi_{f}") for f, h in has.items()],
        )
    ).scalar()
    groups = monthly.groupBy(*keys).agg(*[F.max(h).alias(f"has_{f}") for f, h in has.items()])
    none = F.array().cast("array<date>")
    months = [
        F.when(
            F.col(f"has_{f}"), period_sequence(F.col("_span")[f"lo_{f}"], F.col("_span")[f"hi_{f}"], "M")
        ).otherwise(none)
        for f in MEASURES
    ]
    spine = groups.withColumn("_span", span).select(
        *keys, F.explode(F.array_distinct(F.concat(*months))).alias("date")
    )
    panel = spine.join(monthly.select("date", *keys, *ALL_MEASURES), ["date", *keys], "left")
    return panel.na.fill(0, ALL_MEASURES)


def prepare_series(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    freq: str = "M",
    how: str = "sum",
    date: str = "date",
) -> DataFrame:
    """Regular series (keys, date, value), labelled by the last day of each period.

    Empty periods are 0 for sums; for mean and median they take the nearest earlier, else
    later, value. The spine of a key runs from its own first to its own last period.
    """
    if how not in ("sum", "mean", "median"):
        raise ValueError(f"Unknown aggregation function: {how}")
    start = period_start(date, freq)
    rows = df.where(F.col(date).isNotNull()).select(*keys, start.alias("_p"), F.col(value).cast("double").alias("_v"))
    if how == "median":
        periods = rows.select(*keys, "_p").distinct()
        medians = exact_quantiles(rows, [*keys, "_p"], "_v", {"_v": 0.5})
        grouped = periods.join(medians, [*keys, "_p"], "left")
    else:
        grouped = rows.groupBy(*keys, "_p").agg((F.sum if how == "sum" else F.avg)("_v").alias("_v"))

    # The periods that a key lacks are made from its own: those between a row's and the next one's.
    w = Window.partitionBy(*keys).orderBy("_p")
    spans = grouped.select(*keys, "_p", "_v", F.lead("_p").over(w).alias("_next"))
    until = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("_p"))
    period = F.posexplode(period_sequence(F.col("_p"), until, freq)).alias("_k", "_period")
    series = spans.select(*keys, "_v", period).select(*keys, F.col("_period").alias("_p"), F.when(F.col("_k") == 0, F.col("_v")).alias("value"))
    if how == "sum":
        series = series.withColumn("value", F.coalesce("value", F.lit(0.0)))
    else:
        series = fill_both_ways(series, "value", keys, "_p")
    return series.select(*keys, period_end("_p", freq).alias("date"), "value")


def fill_both_ways(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """Forward fill, then back fill, within each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last_value(value, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first_value(value, ignoreNulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after))


def data_summary(df: DataFrame, name: str = "Dataset") -> DataFrame:
    """One row: rows, columns, date range, distinct places, null cells."""
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    columns = [F.count(F.lit(1)).alias("rows"), sum(nulls[1:], nulls[0]).alias("missing_values")]
    if "date" in df.columns:
        columns += [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    columns += [F.count_distinct(c).alias(f"{c}s") for c in ("state", "district") if c in df.columns]
    return df.agg(*columns).select(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), "*")
