"""Descriptive statistics, distributions, seasonality and rankings of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.columns import place_label, safe_divide
from tallyworks.functions.quantiles import exact_quantiles
from tallyworks.operators.panel import numeric_columns
from tallyworks.operators.stats import co_moments, long_form

INDICATORS = [
    "total_enrolment",
    "total_updates",
    "total_demo_updates",
    "total_bio_updates",
    "update_pressure_index",
    "age_transition_rate",
    "demo_bio_ratio",
]


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(metric, count, mean, std, min, q25, median, q75, max) of the columns (default: all numeric)."""
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    rows = long_form(df, [], columns)
    moments = rows.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(rows, ["metric"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(quartiles, "metric", "left").select(
        "metric", "count", "mean", "std", "min", "q25", "median", "q75", "max"
    )


def indicator_summary(df: DataFrame) -> DataFrame:
    return describe(df, INDICATORS)


def growth_summary(df: DataFrame) -> DataFrame:
    return describe(df, [c for c in df.columns if c.endswith("_growth")])


def summary_statistics(df: DataFrame) -> DataFrame:
    """Key figures of the monthly panel in one row."""
    wanted = {
        "total_enrolment": [("total_enrolment", F.sum), ("avg_monthly_enrolment", F.avg)],
        "total_updates": [("total_updates", F.sum), ("avg_monthly_updates", F.avg)],
        "service_workload": [
            ("avg_service_workload", F.avg), ("max_service_workload", F.max),
            ("avg_update_pressure", F.avg), ("max_update_pressure", F.max),
        ],
        "total_demo_updates": [("total_demographic_updates", F.sum)],
        "total_bio_updates": [("total_biometric_updates", F.sum)],
    }
    figures = [f(c).alias(name) for c, parts in wanted.items() if c in df.columns for name, f in parts]
    return df.agg(*figures)


def monthly_totals(df: DataFrame) -> DataFrame:
    """National totals and mean pressure index per month."""
    return df.groupBy(F.trunc("date", "month").alias("date")).agg(
        *[F.sum(c).alias(c) for c in ("total_enrolment", "total_updates", "total_demo_updates", "total_bio_updates")],
        F.avg("update_pressure_index").alias("update_pressure_index"),
    )


def state_summary(df: DataFrame) -> DataFrame:
    """Totals and mean ratios per state."""
    ratios = [c for c in ("update_pressure_index", "demo_bio_ratio") if c in df.columns]
    return df.groupBy("state").agg(
        F.sum("total_enrolment").alias("total_enrolment"),
        F.sum("total_updates").alias("total_updates"),
        *[F.avg(c).alias(c) for c in ratios],
    )


def overview(df: DataFrame) -> DataFrame:
    """Totals, mean index and number of districts in one row."""
    return df.agg(
        F.sum("total_enrolment").alias("total_enrolment"),
        F.sum("total_updates").alias("total_updates"),
        F.avg("update_pressure_index").alias("avg_update_pressure"),
        F.count_distinct("district").alias("districts"),
        F.count(F.lit(1)).alias("records"),
    )


def totals_by_date(df: DataFrame, metric: str = "total_enrolment") -> DataFrame:
    return df.groupBy("date").agg(F.sum(metric).alias(metric))


def update_split(df: DataFrame) -> DataFrame:
    """(kind, value, share): demographic against biometric updates."""
    one = df.agg(F.sum("total_demo_updates").alias("d"), F.sum("total_bio_updates").alias("b"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("demographic", "d"), ("biometric", "b"))]
    share = safe_divide("value", F.col("d") + F.col("b"))
    return one.select("d", "b", F.inline(F.array(*kinds))).select("kind", "value", share.alias("share"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(metric_a, metric_b, correlation) for every ordered pair, over the rows that have both; see ``co_moments``.

    Null without two such rows, or where one of the columns does not vary.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    pairs = [(min(i, j), max(i, j), a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    named = df.sparkSession.createDataFrame(pairs, "i int, j int, metric_a string, metric_b string")
    spread = F.sqrt("square_i") * F.sqrt("square_j")
    value = F.when((F.col("n") > 1) & (spread > 0), F.try_divide("product", spread))
    joined = named.join(co_moments(df, columns), ["i", "j"], "left")
    return joined.select("metric_a", "metric_b", F.nanvl(value, F.lit(None)).alias("correlation"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """(metric, bin, lower, upper, n): equal bins from the least to the greatest value, empty ones too."""
    bounds = [F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in columns]
    span = df.agg(F.struct(*bounds).alias("s"))

    def edges(s: Column) -> tuple[Column, Column]:
        flat = s["lo"] == s["hi"]
        return F.when(flat, s["lo"] - 0.5).otherwise(s["lo"]), F.when(flat, s["hi"] + 0.5).otherwise(s["hi"])

    placed = df.select(*columns).withColumn("_s", span.scalar())
    entries = []
    for c in columns:
        lo, hi = edges(F.col("_s")[c])
        place = F.floor((F.col(c).cast("double") - lo) * bins / (hi - lo)) + 1
        # The greatest value belongs to the last bin; ``least`` alone would put nulls there too.
        within = F.when(place.isNotNull(), F.least(place, F.lit(bins)))
        entries.append(F.struct(F.lit(c).alias("metric"), within.cast("int").alias("bin")))
    counts = (
        placed.select(F.inline(F.array(*entries))).where("bin IS NOT NULL").groupBy("metric", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    frames = [F.struct(F.lit(c).alias("metric"), F.struct(*[e.alias(n) for e, n in zip(edges(F.col("s")[c]), ("lo", "hi"))]).alias("e")) for c in columns]
    every = span.select(F.inline(F.array(*frames))).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return every.join(counts, ["metric", "bin"], "left").select(
        "metric",
        "bin",
        (F.col("e.lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("e.lo") + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def month_box_statistics(df: DataFrame, metric: str) -> DataFrame:
    """Quartiles, whiskers and outliers of a metric per month of the year."""
    rows = df.select(F.month("date").alias("month"), F.col(metric).cast("double").alias("value")).where("value IS NOT NULL")
    quartiles = exact_quantiles(rows, ["month"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    spread = rows.join(quartiles, "month").groupBy("month").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return quartiles.join(spread, "month").withColumn(
        "month_name", F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMMM")
    )


def month_means(df: DataFrame, metric: str = "total_enrolment") -> DataFrame:
    return df.groupBy(F.month("date").alias("month")).agg(F.avg(metric).alias("mean"))


def seasonality(df: DataFrame, metric: str = "total_enrolment") -> DataFrame:
    """Peak month of the year and how far the largest monthly mean exceeds the smallest."""
    return month_means(df, metric).agg(
        F.max_by("month", F.struct("mean", F.negative("month"))).alias("peak_month"),
        safe_divide(F.max("mean"), F.min("mean")).alias("max_min_ratio"),
    )


def top_districts(df: DataFrame, metric: str = "update_pressure_index", n: int = 10, ascending: bool = False) -> DataFrame:
    """The n districts with the highest (or lowest) mean of a metric."""
    if metric not in df.columns:
        raise ValueError(f"Metric '{metric}' not found")
    means = df.groupBy("state", "district").agg(F.avg(metric).alias(metric))
    by = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return means.orderBy(by, "state", "district").limit(n).withColumn("location", place_label())


def top_states(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n states of a state summary with the largest value."""
    return df.orderBy(F.desc_nulls_last(by), "state").limit(n)


def top_state(df: DataFrame, metric: str = "total_enrolment") -> DataFrame:
    """The state with the largest total (the first by name of equals) and that total."""
    totals = df.groupBy("state").agg(F.sum(metric).alias("total"))
    best = F.min_by("state", F.struct(F.negative("total"), F.col("state")))
    return totals.agg(best.alias("top_state"), F.max("total").alias("top_value"))


def counts_above_mean(df: DataFrame, metric: str = "update_pressure_index", factor: float = 1.5) -> DataFrame:
    """Rows above the mean and above a multiple of it."""
    mean = df.agg(F.avg(metric)).scalar()
    return df.withColumn("_mean", mean).agg(
        F.count_if(F.col(metric) > F.col("_mean")).alias("above_mean"),
        F.count_if(F.col(metric) > F.col("_mean") * factor).alias("well_above_mean"),
    )


def repeatable_sample(df: DataFrame, keys: Sequence[str], n: int = 5000) -> DataFrame:
    """n rows drawn at random, the same ones on every run: those whose ``keys`` and number have the least MD5.

    Rows equal in all columns are numbered, so that each of them is drawn for itself. A threshold on
    the hash leaves a few times n rows to be sorted, whatever the size of ``df``.
    """
    rows = df.agg(F.count(F.lit(1))).scalar()
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    each = each.withColumn("_md5", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("_copy").cast("string"))))
    # The first thirteen digits as a number in [0, 1).
    draw = F.conv(F.substring("_md5", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return each.where(draw * rows < 4.0 * n + 200).orderBy("_md5", *keys).limit(n).select(*df.columns)


def decompose(
    series: DataFrame, keys: Sequence[str], model: str = "additive", period: int | None = None, freq: str = "M"
) -> DataFrame:
    """Trend, season and residual of each series (keys, date, value).

    The trend is the centred moving average over a period, unknown at both ends; the season
    is the mean deviation per phase, centred.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"Unknown model: {model}")
    period = period or {"M": 12, "Q": 4}.get(freq, 7)
    half = period // 2
    w = Window.partitionBy(*keys).orderBy("date")
    rows = series.withColumn("_i", F.row_number().over(w) - 1)
    around = F.sum("value").over(w.rowsBetween(-half, half))
    first, last = F.lag("value", half).over(w), F.lead("value", half).over(w)
    total = around - (first + last) / 2 if period % 2 == 0 else around
    trend = F.when(first.isNotNull() & last.isNotNull(), total / period)
    additive = model == "additive"
    rows = rows.withColumn("trend", trend).withColumn("_phase", F.col("_i") % period)
    detrended = F.col("value") - F.col("trend") if additive else F.try_divide(F.col("value"), F.col("trend"))
    of_phase = Window.partitionBy(*keys, "_phase")
    rows = rows.withColumn("_d", detrended).withColumns(
        {"_mean": F.avg("_d").over(of_phase), "_share": F.count(F.lit(1)).over(of_phase)}
    )
    # Each phase weighs the same, however many points it has.
    centre = F.sum(F.col("_mean") / F.col("_share")).over(Window.partitionBy(*keys)) / period
    rows = rows.withColumn("_centre", centre)
    seasonal = F.col("_mean") - F.col("_centre") if additive else F.try_divide(F.col("_mean"), F.col("_centre"))
    rows = rows.withColumn("seasonal", seasonal)
    residual = F.col("_d") - F.col("seasonal") if additive else F.try_divide(F.col("_d"), F.col("seasonal"))
    return rows.select(*keys, "date", "value", "trend", "seasonal", residual.alias("residual"))
