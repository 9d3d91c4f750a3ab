"""Conforming and cleaning the raw facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import StringType

from tallyworks.functions.columns import title_case, to_number
from tallyworks.functions.dates import FORMS, form_of, parse_date
from tallyworks.operators.panel import numeric_columns
from tallyworks.schemas import FACT_KEYS, MEASURES

# Text columns that identify a row; the rest is expected to be numeric.
TEXT_KEYS = ("state", "district", "pincode")


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names in lower case without surrounding blanks."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def standardise(df: DataFrame, dayfirst: bool = False, forms: Sequence[str] | None = None) -> DataFrame:
    """Names, dates, place labels and numbers brought to one form; bad values become null.

    The base line reads the month first where a text leaves it open. ``forms`` are the forms of dates
    to read, all if not given; see :func:`voted_forms`.
    """
    df = normalise_names(df)

    def conform(field):
        c = F.col(field.name)
        if field.name == "date":
            return (parse_date(c, dayfirst, forms) if isinstance(field.dataType, StringType) else c.cast("date")).alias("date")
        if field.name in ("state", "district"):
            return title_case(c).alias(field.name)
        if isinstance(field.dataType, StringType) and field.name not in TEXT_KEYS:
            return to_number(c).alias(field.name)
        return c

    return df.select(*[conform(f) for f in df.schema])


def standardise_numbers(df: DataFrame) -> DataFrame:
    """What :func:`standardise` does to numbers; keys stay as they are."""
    keys = ("date", *TEXT_KEYS)
    return df.select(
        *[to_number(f.name).alias(f.name) if isinstance(f.dataType, StringType) and f.name not in keys else F.col(f.name) for f in df.schema]
    )


def parse_dates(
    df: DataFrame, date: str = "date", observation: Observation | None = None, dayfirst: bool = True, forms: Sequence[str] | None = None
) -> DataFrame:
    """Dates of the monthly line, which reads the day first; rows without a valid one are left out.

    With an ``Observation`` the dropped rows are counted on the way, see :func:`dated`.
    """
    return dated(df.withColumn(date, parse_date(date, dayfirst, forms)), date, observation)


def dated(df: DataFrame, date: str = "date", observation: Observation | None = None, weight: str | None = None) -> DataFrame:
    """Only rows with a date; an ``Observation`` gets the number of all rows, ``n_rows``, and of the others, ``invalid_dates``.

    ``weight`` names a column that holds how many rows each row stands for.
    """
    if observation is not None:
        n = F.lit(1) if weight is None else F.col(weight)
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
        df = df.observe(observation, total(n, "n_rows"), total(F.when(F.col(date).isNull(), n), "invalid_dates"))
    return df.where(F.col(date).isNotNull())


def date_votes(df: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """(by..., form, n, n_read, day_only, month_only): how many texts are written in each form of dates.

    One aggregation over the distinct texts, per file if ``by`` names a column that holds it. ``n_read`` of the
    ``n`` rows are days of the calendar; ``day_only`` and ``month_only`` are those that are dates only with
    the day or only with the month first. ``form`` is null for texts of no form and for null, which have no votes.
    """
    texts = df.groupBy(*by, F.col(date).cast("string").alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    read = {dayfirst: parse_date("_text", dayfirst) for dayfirst in (True, False)}
    # The first number is a month in one order and a day in the other.
    first = F.regexp_extract("_text", r"([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]", 1).try_cast("int")
    second = F.regexp_extract("_text", r"([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]", 2).try_cast("int")
    open_order = F.col("form").isin("year last", "short year") & read[True].isNotNull()
    votes = texts.withColumn("form", form_of("_text"))
    total = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0)).alias(name)
    return votes.groupBy(*by, "form").agg(
        total(F.lit(True), "n"), total(read[True].isNotNull(), "n_read"),
        total(open_order & (first > 12), "day_only"), total(open_order & (second > 12), "month_only"),
    )


def voted_forms(df: DataFrame, date: str = "date") -> tuple[tuple[str, ...], bool | None]:
    """The forms that the dates of a table have, the most frequent first, and whether the day comes first.

    The order is None where no text shows it, or some texts show either. The forms are what
    :func:`parse_dates` and :func:`standardise` take to read a table with a pattern of its own.
    """
    votes = [v for v in date_votes(df, date).collect() if v.form is not None]
    forms = tuple(v.form for v in sorted(votes, key=lambda v: (-v.n, list(FORMS).index(v.form))))
    day, month = sum(v.day_only for v in votes), sum(v.month_only for v in votes)
    return forms, None if bool(day) == bool(month) else day > 0


def clean_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Coerced to a number, absent as 0, never below 0."""
    return df.withColumns(
        {n: F.greatest(F.coalesce(to_number(n), F.lit(0.0)), F.lit(0.0)) for n in names if n in df.columns}
    )


def date_losses(df: DataFrame, date: str = "date", dayfirst: bool = True) -> DataFrame:
    """How many rows there are, have no date, and have a text that is none and so will be dropped."""
    parsed = parse_date(date, dayfirst)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(date).isNull()).alias("no_date"),
        F.count_if(F.col(date).isNotNull() & parsed.isNull()).alias("unreadable"),
    )


def clean_fact(df: DataFrame, fact: str, observation: Observation | None = None, forms: Sequence[str] | None = None) -> DataFrame:
    """Dates and measures of one raw fact cleaned; the order of rows is left to the sink."""
    return clean_numbers(parse_dates(df, observation=observation, forms=forms), MEASURES[fact])


def fill_numbers(df: DataFrame, fill: float = 0) -> DataFrame:
    return df.na.fill(fill, numeric_columns(df))


def drop_unplaced(df: DataFrame) -> DataFrame:
    """Only rows with a state, a district and a date."""
    return df.na.drop(subset=[c for c in ("state", "district", "date") if c in df.columns])


def handle_missing(df: DataFrame) -> DataFrame:
    """Absent numbers are no activity; rows without place or date are dropped."""
    return drop_unplaced(fill_numbers(df))


def missing_cells(df: DataFrame) -> DataFrame:
    """Null cells before and after :func:`handle_missing`, from one pass."""
    numbers = numeric_columns(df)
    kept = F.lit(True)
    for c in ("state", "district", "date"):
        if c in df.columns:
            kept = kept & F.col(c).isNotNull()
    before = [F.count_if(F.col(c).isNull()) for c in df.columns]
    after = [F.count_if(F.col(c).isNull() & kept) for c in df.columns if c not in numbers] or [F.lit(0)]
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
        sum(before[1:], before[0]).alias("missing_before"),
        sum(after[1:], after[0]).alias("missing_after"),
    )


def fact_columns(df: DataFrame, fact: str) -> DataFrame:
    return df.select(*FACT_KEYS, *MEASURES[fact])
