"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# White space of any kind, no-break spaces among it.
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
# A number in the first group, with white space at either end.
NUMBER = r"^[\s\p{Z}]*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)[\s\p{Z}]*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    """``num / den`` where the denominator is positive, else ``default``."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(default).cast("double"))


def sum_skipping_nulls(names: Iterable[str]) -> Column:
    """Row sum in which a null counts as nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) for n in names], F.lit(0))


def sum_with_nulls(names: Sequence[str]) -> Column:
    """Row sum that is null as soon as one part is."""
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def title_case(c: Column | str) -> Column:
    """Trimmed text with a capital after every non-letter, so also after ``-`` and ``'``.

    ``initcap`` starts a word only after a blank, so a marked blank stands behind every other
    non-letter while it runs. Unlike a lambda over the parts this stays in generated code.
    """
    mark = "\u0001 "
    spaced = F.regexp_replace(stripped(c), r"([^\p{L} ])", f"$1{mark}")
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


def stripped(c: Column | str) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(col(c), _BLANKS, "")


def to_number(c: Column | str) -> Column:
    """Text as a double; anything that is not written as a number is null, never NaN."""
    return F.regexp_extract(col(c).cast("string"), NUMBER, 1).try_cast("double")


def growth_percent(current: Column | str, previous: Column | str) -> Column:
    """Change against the previous value in percent; null without a non-zero previous value."""
    current, previous = col(current).cast("double"), col(previous).cast("double")
    return F.try_divide(current - previous, previous) * 100


def bucket(c: Column | str, edges: Sequence[tuple[float, str]], last: str, null: str | None = None) -> Column:
    """Label of the first edge the value lies below, else ``last``; null gets its own label."""
    value = col(c)
    out = F.when(value.isNull(), F.lit(null))
    for upper, label in edges:
        out = out.when(value < upper, F.lit(label))
    return out.otherwise(F.lit(last))


def above(c: Column | str, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first step the value lies strictly above, else ``default``."""
    out = F
    for lower, label in steps:
        out = out.when(col(c) > lower, F.lit(label))
    return out.otherwise(F.lit(default))


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends only on the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def place_label(state: Column | str = "state", district: Column | str = "district") -> Column:
    return F.concat_ws(" - ", col(state), col(district))


def with_date_parts(df, date: str = "date"):
    """Add month number, month name and quarter of the date."""
    return df.withColumns(
        {
            "month": F.month(date),
            "month_name": F.date_format(date, "MMMM"),
            "quarter": F.quarter(date),
        }
    )


def period_start(date: Column | str, freq: str) -> Column:
    """First day of the day, week (from Monday), month, quarter or year the date lies in."""
    if freq == "D":
        return col(date).cast("date")
    if freq not in PERIOD_UNITS:
        raise ValueError(f"Unknown frequency: {freq}")
    return F.trunc(col(date), PERIOD_UNITS[freq])


def period_end(start: Column | str, freq: str) -> Column:
    """Last day of a period given its first day."""
    if freq in ("D", "W"):
        return F.date_add(col(start), 0 if freq == "D" else 6)
    months = {"M": 1, "Q": 3, "Y": 12}[freq]
    return F.date_sub(F.add_months(col(start), months), 1)


PERIOD_UNITS = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}
PERIOD_STEPS = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}


def period_sequence(first: Column, last: Column, freq: str) -> Column:
    """Array of the first days of all periods from ``first`` to ``last``."""
    return F.sequence(first, last, F.expr(f"INTERVAL {PERIOD_STEPS[freq]}"))


def future_dates(last: Column | str, periods: int, freq: str = "MS") -> Column:
    """Array of (step, date) for the periods after ``last``.

    ``MS`` labels months by their first day; the other frequencies label by the last day.
    """
    last = col(last)

    def date_at(i: Column) -> Column:
        if freq in ("D", "W"):
            return F.date_add(last, i if freq == "D" else i * 7)
        months, unit = {"MS": (1, "month"), "M": (1, "month"), "Q": (3, "quarter"), "Y": (12, "year")}[freq]
        if freq == "MS":
            return F.add_months(F.trunc(last, unit), i)
        return F.date_sub(F.add_months(F.trunc(last, unit), (i + 1) * months), 1)

    steps = F.sequence(F.lit(1), F.lit(periods))
    return F.transform(steps, lambda i: F.struct(i.alias("step"), date_at(i).alias("date")))


def explode_future(df, last: str, periods: int, freq: str = "MS"):
    """One row per future period, with ``step`` and ``date``."""
    return df.select("*", F.inline(future_dates(last, periods, freq)))
