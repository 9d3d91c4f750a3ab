"""Texts read as dates: every usual form by one compiled pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Names of months and week days as dates write them.
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_WEEKDAY = "(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Slots of a form's groups: y year, m month, d day, n name of a month; a and b are day and month in either order.
_NAMED, _NTH, _SEP = f"({_MONTH})[.]?", "([0-9]{1,2})(?:st|nd|rd|th)?", "[-/. ,]+(?:of )?"
FORMS: dict[str, tuple[str, str]] = {
    "year first": ("([0-9]{4})[-/. ]([0-9]{1,2})[-/. ]([0-9]{1,2})", "ymd"),
    "year last": ("([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{4})", "aby"),
    "short year": ("([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2})", "aby"),
    "eight digits": ("([0-9]{4})([0-9]{2})([0-9]{2})", "ymd"),
    "day and name": (f"{_NTH}{_SEP}{_NAMED}{_SEP}([0-9]{{4}}|[0-9]{{2}})", "dny"),
    "name and day": (f"{_NAMED}{_SEP}{_NTH}{_SEP}([0-9]{{4}})", "ndy"),
    "year and name": (f"([0-9]{{4}}){_SEP}{_NAMED}{_SEP}([0-9]{{1,2}})", "ynd"),
    "month": ("([0-9]{4})[-/.]([0-9]{1,2})", "ym"),
    "name of month": (f"{_NAMED}{_SEP}([0-9]{{4}})", "ny"),
}
_SLOTS = "ymdnab"

_BLANK = r"[\s\p{Z}]*"
_CLOCK = r"(?:[01]?[0-9]|2[0-3])(?::[0-5][0-9]){1,2}(?:[.,][0-9]+)?(?: ?[ap][.]?m[.]?)?|(?:0?[0-9]|1[0-2]) ?[ap][.]?m[.]?"
_ZONE = "(?: ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?"
_BEFORE, _AFTER = f"(?i)^{_BLANK}(?:{_WEEKDAY}[., ]+)?", f"(?:(?:t|[, ]+)(?:{_CLOCK}){_ZONE})?{_BLANK}$"
# Stands before every slot once a text has been taken apart; no date has it.
_MARK = "\u0001"

# Years of two digits below this are of this century, as strptime reads them.
_PIVOT = 69


def pattern(forms: Sequence[str]) -> tuple[str, str]:
    """One pattern for all the forms, and the replacement that turns a text into marked slots."""
    groups: dict[str, list[int]] = {s: [] for s in _SLOTS}
    n, parts = 0, []
    for name in forms:
        part, slots = FORMS[name]
        parts.append(part)
        for slot in slots:
            n += 1
            groups[slot].append(n)
    # A text has one form, so of the groups of a slot at most one is not empty.
    slots = "".join(_MARK + "".join(f"${i}" for i in groups[s]) for s in _SLOTS)
    return f"{_BEFORE}(?:{'|'.join(parts)}){_AFTER}", slots


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _fixed_widths(c: Column, dayfirst: bool) -> Column:
    """Date of two digits, two and four, parted by ``-`` or ``/``, or of ``yyyy-MM-dd``, without a failing parse per row."""
    sep, ten = F.substring(c, 3, 1), F.length(c) == 10
    first, second = F.substring(c, 1, 2), F.substring(c, 4, 2)
    turned = F.concat_ws("-", F.substring(c, 7, 4), *((second, first) if dayfirst else (first, second)))
    iso = (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-")
    text = F.when(ten & sep.isin("-", "/") & (F.substring(c, 6, 1) == sep), turned).when(ten & iso, c)
    return text.try_cast("date")


def _from_slots(slots: Column, dayfirst: bool) -> Column:
    """Date of the slots; null where there is no such day."""
    y, m, d, n, a, b = (F.element_at(slots, i + 2) for i in range(len(_SLOTS)))
    year = F.when(F.length(y) == 2, F.concat(F.when(y < str(_PIVOT), "20").otherwise("19"), y)).otherwise(y)
    named = ((F.position(F.substring(F.lower(n), 1, 3), F.lit(_MONTHS)) + 2) / 3).cast("int").cast("string")

    def date(month: Column, day: Column) -> Column:
        return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")

    first, second = (date(b, a), date(a, b)) if dayfirst else (date(a, b), date(b, a))
    return F.when(a != "", F.coalesce(first, second)).otherwise(date(F.when(n != "", named).otherwise(m), F.when(d != "", d).otherwise("1")))


def parse_date(c: Column | str, dayfirst: bool = True, forms: Sequence[str] | None = None) -> Column:
    """Text as a date, else null; blanks around it, a week day before it and a time of day after it do not matter.

    Read are the ``forms``, all of ``FORMS`` if not given:

    - day, month and year in digits, parted by ``-``, ``/``, ``.`` or a blank, the year first or last; eight digits;
    - a month by name, in any place, the day with or without ``th``;
    - a month alone (``2023-01``, ``Jan 2023``), which stands for its first day.

    Of digits that end with the year ``dayfirst`` says which of the others comes first, unless only the other
    order is a date. Years of two digits are of 1969 to 2068. One column may mix forms; each text is read alone.
    """
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    whole, replacement = pattern(tuple(FORMS) if forms is None else forms)
    slots = F.split(F.regexp_replace(text, whole, replacement), _MARK)
    # The pattern runs where no usual width fits, and once.
    read = _let(F.when(~F.contains(text, F.lit(_MARK)), slots), lambda s: F.when(F.size(s) > len(_SLOTS), _from_slots(s, dayfirst)))
    return F.coalesce(_fixed_widths(text, dayfirst), read)


def with_date(df: DataFrame, c: str, dayfirst: bool = True, forms: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the text ``c`` replaced by what :func:`parse_date` reads in it.

    What is used more than once are columns of their own here, so all of it is compiled; a lambda is not. For the start
    of a stage: with much else in one step the compiled method grows beyond the 8,000 bytes that a JVM optimises.
    """
    fixed, slots = f"_fixed {c}", f"_slots {c}"
    text = F.col(f"`{c}`").cast("string")
    whole, replacement = pattern(tuple(FORMS) if forms is None else forms)
    df = df.withColumn(fixed, _fixed_widths(text, dayfirst))
    apart = F.split(F.regexp_replace(text, whole, replacement), _MARK)
    df = df.withColumn(slots, F.when(F.col(f"`{fixed}`").isNull() & ~F.contains(text, F.lit(_MARK)), apart))
    read = F.when(F.size(f"`{slots}`") > len(_SLOTS), _from_slots(F.col(f"`{slots}`"), dayfirst))
    return df.withColumn(c, F.coalesce(F.col(f"`{fixed}`"), read)).drop(fixed, slots)


def form_of(c: Column | str) -> Column:
    """Name of the form that a text is written in, by its looks; null for texts of none."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    found = [F.when(F.regexp_like(text, F.lit(pattern([name])[0])), F.lit(name)) for name in FORMS]
    return F.coalesce(*found)
