"""From raw facts to the unified table and the monthly panel."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType

from tallyworks.functions.dates import with_date
from tallyworks.functions.lineage import materialise
from tallyworks.operators import cleaning, indicators, panel
from tallyworks.schemas import ALL_MEASURES, FACT_KEYS, MEASURES
from tallyworks.sources import files

LEVELS = {"national": [], "state": ["state"], "district": ["state", "district"]}


def summed_base(raw: DataFrame, fact: str, observation: Observation | None = None, forms: Sequence[str] | None = None) -> DataFrame:
    """Base line: labels in title case, numbers coerced, absent as 0, negative kept; rows whose keys are the same texts summed.

    Numbers are read row by row. Dates and labels cost far more and are read once per distinct key, of which a fact has
    at most its days times its places; if hardly any repeats, that costs one shuffle more. Rows without a place go
    first. A row without a postal code is kept, under code 0.
    """
    names, count = MEASURES[fact], "_rows"
    placed = cleaning.normalise_names(raw).where("state IS NOT NULL AND district IS NOT NULL")
    numbers = cleaning.fill_numbers(cleaning.standardise_numbers(cleaning.fact_columns(placed, fact)))
    kind = numbers.schema[names[0]].dataType
    sums = numbers.groupBy(*FACT_KEYS).agg(*[F.sum(F.col(m).cast(kind)).alias(m) for m in names], F.count(F.lit(1)).alias(count))
    if isinstance(sums.schema["date"].dataType, StringType):
        sums = with_date(sums, "date", dayfirst=False, forms=forms)
    clean = cleaning.dated(cleaning.standardise(sums), observation=observation, weight=count)
    return cleaning.fact_columns(clean.na.fill("0", ["pincode"]), fact)


# What a pipeline has dropped for want of a date: by fact an ``Observation`` of ``n_rows`` and
# ``invalid_dates``, filled by the first action on the result.
Losses = dict[str, Observation]


def _watched(facts: Iterable[str], losses: Losses | None) -> Losses:
    """An observation for each fact, also without anyone to ask for it: query listeners see them all, by name."""
    watched = {} if losses is None else losses
    watched.update({f: Observation(f"dates of {f} {uuid.uuid4().hex}") for f in facts})
    return watched


def _forms(raw: Mapping[str, DataFrame], vote: bool) -> dict[str, Sequence[str] | None]:
    """The forms of dates to read in each fact: all, or those found by a vote, which scans the texts once more."""
    if not vote:
        return dict.fromkeys(raw)
    found = {f: cleaning.voted_forms(cleaning.normalise_names(df))[0] for f, df in raw.items()}
    return {f: forms or None for f, forms in found.items()}


def preprocess_all(raw: Mapping[str, DataFrame], keys: Sequence[str] = tuple(FACT_KEYS), losses: Losses | None = None, vote: bool = False) -> DataFrame:
    """Base line from raw facts to the unified table, by day and place.

    Rows whose date cannot be read go; how many, ``losses`` is told. With ``vote`` each fact is read by a pattern of
    the forms its own dates have.
    """
    watched, forms = _watched(raw, losses), _forms(raw, vote)
    facts = panel.stack_facts({f: summed_base(df, f, watched[f], forms[f]) for f, df in raw.items()})
    return panel.unify(facts, keys, complete=True)


def preprocess_folder(spark: SparkSession, data_dir: str, losses: Losses | None = None, vote: bool = False) -> DataFrame:
    return preprocess_all(files.load_datasets(spark, data_dir), losses=losses, vote=vote)


def monthly_panel(activity: DataFrame, level: str = "state") -> DataFrame:
    """Dense monthly panel of the stacked facts at ``national``, ``state`` or ``district`` level.

    ``both`` stacks the national and the state panel, marked by ``level``. The facts are
    scanned once: what follows the roll-up works on its stage table.
    """
    if level == "both":
        state = monthly_panel(activity, "state")
        nation = panel.aggregate(state, ["date"], ALL_MEASURES).withColumn("state", F.lit("All"))
        return state.withColumn("level", F.lit("State")).unionByName(nation.withColumn("level", F.lit("National")))
    if level not in LEVELS:
        raise ValueError(f"Unknown level: {level}")
    keys = LEVELS[level]
    rolled = materialise(panel.monthly_by_fact(activity, keys), "monthly")
    return panel.densify(rolled, keys)


def clean_monthly(raw: Mapping[str, DataFrame], losses: Losses | None = None, vote: bool = False) -> DataFrame:
    """Monthly line's cleaning: day-first dates, numbers never below 0, labels as they are; facts stacked.

    ``losses`` and ``vote`` as in :func:`preprocess_all`.
    """
    watched, forms = _watched(raw, losses), _forms(raw, vote)
    return panel.stack_facts({f: cleaning.fact_columns(cleaning.clean_fact(df, f, watched[f], forms[f]), f) for f, df in raw.items()})


def load_monthly(
    spark: SparkSession, data_path: str, level: str = "state", losses: Losses | None = None, vote: bool = False, folders: Mapping[str, str] | None = None
) -> DataFrame:
    """Monthly panel from the CSV folders of the three facts; ``folders`` names those that are not found by their endings."""
    raw = {f: files.load_fact(spark, data_path, f, (folders or {}).get(f)) for f in files.FACT_FOLDERS}
    return monthly_panel(clean_monthly(raw, losses, vote), level)


def indicator_panel(activity: DataFrame, level: str = "state") -> DataFrame:
    """Monthly panel with all its indicators, as a stage table for the reports on it."""
    keys = LEVELS[level]
    return materialise(indicators.panel_indicators(monthly_panel(activity, level), keys), "panel")


def dashboard_panel(activity: DataFrame) -> DataFrame:
    """State panel as the dashboard reads it: a constant district where there is none."""
    return indicator_panel(activity, "state").withColumn("district", F.lit("All Districts"))


def district_panel(activity: DataFrame) -> DataFrame:
    """Base line by month, state and district: unified, with the base indicators; a stage table."""
    rows = activity.withColumn("date", F.trunc("date", "month"))
    unified = panel.unify(rows, ["date", "state", "district"])
    return materialise(indicators.base_indicators(unified), "district-panel")
