"""Unusual values: z-score, fences, isolation forest, grading and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.quantiles import exact_quantiles
from tallyworks.operators.filters import any_flag
from tallyworks.operators.forest import Forest, detect_isolation_forest
from tallyworks.operators.stats import long_form, with_group_stats, with_scalars

# Order of the grades in a report; an ungraded row comes last.
SEVERITY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
SIGNAL_TYPE = "Operational Signal"


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def detect_zscore(df: DataFrame, column: str, threshold: float = 3.0, group_by: Sequence[str] = ()) -> DataFrame:
    """Add ``zscore`` (sample deviation) and ``is_anomaly_zscore``, within groups or over all rows.

    A group of one row or of equal values has no z-score and no flags.
    """
    keys = [k for k in group_by if k in df.columns]
    stats = {"_mean": F.avg(F.col(column).cast("double")), "_std": F.stddev_samp(column)}
    z = F.try_divide(F.col(column) - F.col("_mean"), F.col("_std"))
    return (
        with_group_stats(df, keys, stats)
        .withColumn("zscore", z)
        .withColumn("is_anomaly_zscore", _flag(F.abs("zscore") > threshold))
        .drop("_mean", "_std")
    )


def iqr_bounds(df: DataFrame, column: str, multiplier: float = 1.5, group_by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and fences per group."""
    quartiles = exact_quantiles(df, list(group_by), column, {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * multiplier
    return quartiles.withColumn("lower", F.col("q1") - reach).withColumn("upper", F.col("q3") + reach)


def detect_iqr(df: DataFrame, column: str, multiplier: float = 1.5, group_by: Sequence[str] = ()) -> DataFrame:
    """Add ``is_anomaly_iqr``: strictly outside the fences. ``df`` is read more than once."""
    keys = [k for k in group_by if k in df.columns]
    bounds = iqr_bounds(df, column, multiplier, keys).select(*keys, F.col("lower").alias("_lo"), F.col("upper").alias("_hi"))
    if keys:
        joined = df.join(bounds, keys, "left")
    else:
        joined = with_scalars(df, bounds.select(F.struct("_lo", "_hi")), ["_lo", "_hi"])
    outside = (F.col(column) < F.col("_lo")) | (F.col(column) > F.col("_hi"))
    return joined.withColumn("is_anomaly_iqr", _flag(outside)).drop("_lo", "_hi")


def severity(zscore: str = "zscore", iqr: str = "is_anomaly_iqr", iforest: str | None = None) -> Column:
    """Grade from the size of the z-score and the number of methods that fired."""
    z = F.coalesce(F.abs(zscore), F.lit(0.0))
    flags = [z > 3, _flag(F.col(iqr)), _flag(F.col(iforest)) if iforest else F.lit(False)]
    fired = sum([f.cast("int") for f in flags[1:]], flags[0].cast("int"))
    return (
        F.when((z > 4) | (fired == 3), "Critical")
        .when((z > 3) | (fired >= 2), "High")
        .when(fired == 1, "Medium")
        .when(z > 2, "Low")
        .otherwise("Normal")
    )


def detection_methods(zscore: str = "is_anomaly_zscore", iqr: str = "is_anomaly_iqr", iforest: str | None = None) -> Column:
    """Comma list of the methods that fired."""
    named = [(zscore, "Z-Score"), (iqr, "IQR")] + ([(iforest, "IsolationForest")] if iforest else [])
    return F.concat_ws(", ", *[F.when(F.col(c), F.lit(label)) for c, label in named])


def severity_rank(c: str = "severity") -> Column:
    out = F
    for name, rank in SEVERITY_RANK.items():
        out = out.when(F.col(c) == name, rank)
    return out


def report_order(report: DataFrame) -> DataFrame:
    """Gravest first, then by date; the rest of the columns makes the order total."""
    rest = [c for c in ("metric", "state", "district") if c in report.columns]
    return report.orderBy(severity_rank().asc_nulls_last(), "date", *rest)


def anomaly_report(
    df: DataFrame,
    metrics: Sequence[str],
    date: str = "date",
    state: str | None = "state",
    district: str | None = None,
    zscore_threshold: float = 3.0,
    use_isolation_forest: bool = True,
    forest: Forest | None = None,
) -> DataFrame:
    """Graded signals of all metrics: one row per row and metric that any method flags.

    z-score and fences work within a state, the forest over all metrics together and is
    fitted once, or given. ``df`` is read more than once: pass a stage table.
    """
    metrics = [m for m in metrics if m in df.columns]
    state = state if state in df.columns else None
    district = district if district in df.columns else None
    ids = [c for c in (date, state, district) if c]
    iforest = "is_anomaly_iforest" if use_isolation_forest and len(metrics) > 1 else None
    if iforest:
        df = detect_isolation_forest(df, metrics, forest=forest)
        ids_and_flag = [*ids, iforest]
    else:
        ids_and_flag = ids
    rows = long_form(df, ids_and_flag, metrics)
    keys = ["metric"] + ([state] if state else [])
    flagged = detect_iqr(detect_zscore(rows, "value", zscore_threshold, keys), "value", 1.5, keys)
    flags = ["is_anomaly_zscore", "is_anomaly_iqr"] + ([iforest] if iforest else [])
    report = flagged.where(any_flag(*flags)).select(
        F.col(date).alias("date"),
        "metric",
        "value",
        F.abs("zscore").alias("zscore"),
        severity(iforest=iforest).alias("severity"),
        detection_methods(iforest=iforest).alias("detection_methods"),
        F.lit(SIGNAL_TYPE).alias("signal_type"),
        *([F.col(state).alias("state")] if state else []),
        *([F.col(district).alias("district")] if district else []),
    )
    return report_order(report)


def _counts(df: DataFrame, dimensions: Sequence[str], total: bool) -> DataFrame:
    """(dimension, key, n) over several dimensions at once."""
    cols = [F.col(d) for d in dimensions]
    sets = [[c] for c in cols] + ([[]] if total else [])
    grouped = df.groupingSets(sets, *cols).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    dimension, key = F, F
    for d in dimensions:
        dimension = dimension.when(F.col(f"_g_{d}") == 0, d)
        key = key.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string"))
    return grouped.select(dimension.otherwise("total").alias("dimension"), key.otherwise("all").alias("key"), "n")


def anomaly_summary(report: DataFrame) -> DataFrame:
    """Signals by severity, metric and state, and in total, as (dimension, key, n)."""
    dimensions = [d for d in ("severity", "metric", "state") if d in report.columns]
    counts = _counts(report.select(*dimensions), dimensions, total=False)
    total = report.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("dimension"), F.lit("all").alias("key"), "n")
    return counts.unionByName(total)


# Metrics whose signals point at staffing, with their plain names.
UPDATE_METRICS = {
    "service_workload": "service workload",
    "total_updates": "total updates",
    "total_bio_updates": "total biometric updates",
}


def administrative_suggestions(report: DataFrame, top_states: int = 3, top_months: int = 2) -> DataFrame:
    """Advice that follows from a report, as (position, rule, suggestion)."""
    has_state = "state" in report.columns
    dimensions = ["severity", "metric"] + (["state"] if has_state else []) + ["month"]
    counts = _counts(report.withColumn("month", F.month("date")).select(*dimensions), dimensions, total=False)
    ranked = counts.withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("dimension").orderBy(
                F.desc("n"), F.when(F.col("dimension") == "month", F.lpad("key", 2, "0")).otherwise(F.col("key"))
            )
        ),
    )

    def count_of(dimension: str, key: str) -> Column:
        found = (F.col("dimension") == dimension) & (F.col("key") == key)
        return F.coalesce(F.max(F.when(found, F.col("n"))), F.lit(0))

    def leaders(dimension: str, k: int, shown: Column) -> Column:
        found = (F.col("dimension") == dimension) & (F.col("rank") <= k)
        best = F.sort_array(F.collect_list(F.when(found, F.struct("rank", shown.alias("shown")))))
        return F.array_join(F.transform(best, lambda s: s["shown"]), ", ")

    month_name = F.date_format(F.make_date(F.lit(2000), F.col("key").try_cast("int"), F.lit(1)), "MMMM")
    month_name = F.when(F.col("dimension") == "month", month_name)
    facts = ranked.agg(
        count_of("severity", "Critical").alias("critical"),
        F.count(F.lit(1)).alias("any"),
        *[count_of("metric", m).alias(f"n_{m}") for m in UPDATE_METRICS],
        leaders("state", top_states, F.col("key")).alias("states"),
        leaders("month", top_months, month_name).alias("months"),
    )

    def rule(position: int, name: str, fired: Column, text: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("rule"), fired.alias("fired"), text.alias("suggestion")
        )

    rules = [
        rule(0, "none", F.col("any") == 0, F.lit("No unusual activity found; operations look normal.")),
        rule(1, "critical", F.col("critical") > 0,
             F.format_string("%s critical signals: review the places and periods at once.", F.col("critical").cast("string"))),
    ]
    for i, (m, plain) in enumerate(UPDATE_METRICS.items()):
        rules.append(rule(2 + i, f"metric_{m}", F.col(f"n_{m}") > 0, F.lit(f"Unusual {plain}: check staffing at the centres.")))
    rules += [
        rule(5, "states", F.col("states") != "", F.format_string("Signals gather in %s: review these first.", "states")),
        rule(6, "months", F.col("months") != "", F.format_string("Most signals fall in %s: watch these months closely.", "months")),
    ]
    return facts.select(F.inline(F.array(*rules))).where("fired").select("position", "rule", "suggestion").orderBy("position")


def consensus_zscore(df: DataFrame, metrics: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Absolute population z-score of each metric (absent counts as 0) and whether any exceeds the threshold."""
    names, stats = [], []
    for m in metrics:
        x = F.coalesce(F.col(m).cast("double"), F.lit(0.0))
        stats += [F.avg(x).alias(f"_mean_{m}"), F.stddev_pop(x).alias(f"_std_{m}")]
        names += [f"_mean_{m}", f"_std_{m}"]
    out = with_scalars(df, df.agg(F.struct(*stats).alias("s")), names)
    z = {
        f"{m}_zscore": F.abs(F.try_divide(F.coalesce(F.col(m), F.lit(0.0)) - F.col(f"_mean_{m}"), F.col(f"_std_{m}")))
        for m in metrics
    }
    scores = [F.col(n) for n in z]
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return out.withColumns(z).withColumn("is_anomaly", _flag(most > threshold)).drop(*names)


def anomaly_rates(df: DataFrame, metrics: Sequence[str], threshold: float = 3.0, flag: str = "is_anomaly") -> DataFrame:
    """(metric, n, percent): flagged rows overall (``any``) and per metric, in one pass."""
    counts = {"any": F.count_if(F.col(flag)), **{m: F.count_if(F.col(f"{m}_zscore") > threshold) for m in metrics}}
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in counts.items()])
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in counts]
    return one.select("_rows", F.inline(F.array(*rows))).select(
        "metric", "n", (F.try_divide(F.col("n").cast("double"), F.col("_rows")) * 100).alias("percent")
    )


def anomalies_per_date(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return df.groupBy("date").agg(F.count_if(F.col(flag)).alias("anomaly_count"))


def anomaly_peak(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Date with most signals (the earliest of equals), its count and the mean per date."""
    return anomalies_per_date(df, flag).agg(
        F.max_by("date", F.struct("anomaly_count", F.negative(F.unix_date("date")))).alias("peak_date"),
        F.max("anomaly_count").alias("peak_count"),
        F.avg("anomaly_count").alias("mean_per_date"),
    )


def anomalies_per_state(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return df.where(F.col(flag)).groupBy("state").agg(F.count(F.lit(1)).alias("anomaly_count"))


def anomaly_frequency(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return df.where(F.col(flag)).groupBy("state", "district").agg(F.count(F.lit(1)).alias("frequency"))


def repetition_summary(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """How many districts were flagged once, how many more often, and the most often."""
    return anomaly_frequency(df, flag).agg(
        F.count_if(F.col("frequency") == 1).alias("single"),
        F.count_if(F.col("frequency") > 1).alias("repeated"),
        F.max("frequency").alias("max_frequency"),
    )


def method_comparison(df: DataFrame, a: str = "is_anomaly", b: str = "is_anomaly_iforest") -> DataFrame:
    """Rows flagged by either method and by both."""
    a, b = F.col(a), F.col(b)
    return df.agg(
        F.count_if(a).alias("zscore_anomalies"), F.count_if(b).alias("iforest_anomalies"), F.count_if(a & b).alias("overlap")
    )


def with_status(anomalies: DataFrame, keys: Sequence[str] = ("state", "district")) -> DataFrame:
    """``Repeated`` where the place has more than one signal, else ``Single``."""
    counted = with_group_stats(anomalies, keys, {"_count": F.count(F.lit(1))})
    return counted.withColumn("status", F.when(F.col("_count") > 1, "Repeated").otherwise("Single")).drop("_count")


def largest(df: DataFrame, by: str, n: int, ties: Sequence[str] = ("date", "state", "district")) -> DataFrame:
    """The n rows with the largest value."""
    return df.orderBy(F.desc_nulls_last(by), *[t for t in ties if t in df.columns]).limit(n)
