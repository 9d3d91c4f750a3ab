"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.lineage import materialise

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

# The row of the caller, kept whole beside an operator's own columns.
ROW = "_row"


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The caller's row as one struct, and ``columns`` beside it.

    Whatever the caller's columns are called, none can clash with an operator's own.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[c.alias(n) for n, c in columns.items()])


def row_only(df: DataFrame) -> DataFrame:
    """The caller's rows again, under their own names."""
    fields = df.schema[ROW].dataType.fieldNames()
    return df.select(*[F.col(ROW).getField(f).alias(f) for f in fields])


def text_of(column: str) -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows with their number from 0 in ``order``, found without one task seeing them all.

    Range partitions are sorted and written; a row's number is its place in its partition plus
    the sizes of the partitions before. Only those sizes, one per partition, meet in one task.
    """
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(shuffled, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(
        placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")).drop("_at"),
        "numbered",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(starts, "_part")
    return joined.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_part", "_place", "_start")


# Keys with more than this part of all rows are joined apart.
HEAVY_PARTS = 2000


def spread_join(rows: DataFrame, small: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """Inner join of ``rows`` with one row per key, of which ``n`` says how many of the rows have it; ``n`` goes.

    Fewer than ``HEAVY_PARTS`` keys can have more than that part of the rows. Those are broadcast, so their rows stay where they are;
    what is dealt by key are the others' rows, no group of which is larger.
    """
    total = small.agg(F.sum(n)).scalar()
    heavy = F.coalesce(F.col(n) * HEAVY_PARTS > total, F.lit(False))
    few, rest = small.where(heavy).drop(n), small.where(~heavy).drop(n)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(others.join(rest, key))
