"""Quality rules as a ledger: measure every text once, keep one bit per failed rule, decide later.

The ledger holds the measurements and ``failed``, a number whose bit k is set if rule k fails.
A policy is a version and a set of rules; applying one, or asking what dropping a rule would
change, needs the bits alone and never the texts again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.llm.common import let, words


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Callable[[], Column]  # of the measurements


# A rule keeps its bit for good; new rules take new bits, so that old ledgers stay readable.
RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", 2, lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("duplicate_lines", 3, lambda: 10 * F.col("n_dup_lines") > 6 * F.col("n_lines")),
    Rule("capitals", 4, lambda: 100 * F.col("n_capitals") > 40 * F.col("word_chars")),
    Rule("word_length", 5, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("repeated_neighbours", 6, lambda: 100 * F.col("n_twice") > 20 * F.col("n_words")),
)

# Policies by version: the rules a text must not fail.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: tuple(r.name for r in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_twice")


def mask(version: int) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def _windows(w: Column) -> Column:
    """Hashes of the 3-word windows of an array of words, in order."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))


def _words_in_repeats(h: Column) -> Column:
    """How many words lie in windows that occur twice or more, given the windows' hashes."""

    def covered(s: Column) -> Column:
        same = lambda e, other: F.coalesce(e["x"] == other["x"], F.lit(False))
        twice = F.filter(s, lambda e, i: same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1)))
        places = lambda k: F.transform(twice, lambda e: e["i"] + k)
        return F.size(F.array_distinct(F.concat(places(0), places(1), places(2))))

    in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(in_order, covered))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and the measurements, all whole numbers.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_lines``
    (lines with a word), ``n_dup_lines`` (of those, equal to an earlier one), ``n_repeat_words``
    (words in 3-word windows found twice or more, the first included), ``n_capitals`` (upper-case
    letters), ``n_twice`` (words equal to the word before). A null or empty text measures 0
    throughout. Repeated rows give a row each; the caller's other columns are left out.

    Windows are compared by a 64-bit hash within one text. Everything happens within the row,
    whatever its length: there is no shuffle, so no hot key.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        let(_windows(F.col("words")), _words_in_repeats).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("words", lambda x, i: x == F.get("words", i - 1))).cast("long").alias("n_twice"),
    ).select("doc_id", *[F.col(f"lines.{m}") if m in ("n_lines", "n_dup_lines") else F.col(m) for m in MEASURES])


def ledger(docs: DataFrame, **columns: str) -> DataFrame:
    """The measurements of every document and ``failed``, the bits of the rules it fails."""
    failed = sum((F.when(r.fails(), F.lit(1 << r.bit)).otherwise(0) for r in RULES), F.lit(0))
    return measured(docs, **columns).withColumn("failed", failed.cast("long"))


def verdicts(rows: DataFrame, version: int) -> DataFrame:
    """A ledger with ``kept``: the text fails none of the rules of the policy."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(version))) == 0)


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of the policy: ``n_failed``, ``n_kept_without`` (texts kept if it is dropped) and
    ``n_only`` (texts that it alone rejects). An empty ledger gives a row of zeros per rule.

    Counted per combination of bits first, of which there are 2 to the number of rules at most.
    """
    spark, bits = rows.sparkSession, mask(version)
    combinations = rows.groupBy(F.col("failed").bitwiseAND(F.lit(bits)).alias("failed")).agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(r.name, 1 << r.bit) for r in RULES if r.name in POLICIES[version]], "rule string, bit long")
    rest = F.col("failed").bitwiseAND(F.bitwise_not("bit"))
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    # Each rule meets each combination of bits: both sides are bounded by the rules.
    paired = asked.join(combinations, F.lit(True), "left")
    return paired.groupBy("rule").agg(
        count(fails).alias("n_failed"), count(rest == 0).alias("n_kept_without"), count(fails & (rest == 0)).alias("n_only")
    )
