"""Repeated runs of lines across a corpus, found by winnowing and deleted but for the first.

From every line with a word a window reaches as far as ``min_words`` words, forwards and back. Its line with the
least hash is its fingerprint: equal runs of that many words have equal windows, so they are
certain to select equal fingerprints. Positions with a fingerprint found elsewhere are joined on
what the whole window around it says; the matches are extended both ways over the neighbouring windows that
match as well, and every run but the earliest is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyworks.functions.lineage import materialise
from tallyworks.llm.common import ROW, SPACES, n_words, row_only, spread_join, with_row

# Words that a run must have to count as repeated.
MIN_WORDS = 50


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _document_key(id_col: str, text_col: str) -> Column:
    """The same for rows of the same id and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text"))


def windows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """key, pos, end, least, content: the windows that begin and that end with each line, as far as there are words enough.

    ``pos`` and ``end`` number the lines of the text, ``least`` is the least line hash of the window,
    ``content`` a hash of its lines in order. Lines are compared without white space at either end;
    lines without a word are passed over. Rows of the same id and text are one document. Every run of ``min_words``
    words is covered by the windows within it: its first lines by those that begin with them, its last by those that end.
    """
    each = F.filter(
        F.transform(_split(F.col(f"`{text_col}`").cast("string")), lambda line, i: F.struct(i.alias("pos"), _trimmed(line).alias("line"))),
        lambda x: x["line"] != "",
    )
    lines = docs.select(_document_key(id_col, text_col).alias("key"), F.explode(each).alias("x"))
    lines = lines.select("key", F.col("x.pos").alias("pos"), F.xxhash64("x.line").alias("hash"), n_words(F.col("x.line")).alias("words"))
    # Rows that repeat are one document; what they say of a line is the same.
    lines = lines.repartition("key").groupBy("key", "pos").agg(F.min("hash").alias("hash"), F.min("words").alias("words"))
    upto = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ahead = Window.partitionBy("key").orderBy("before").rangeBetween(0, min_words - 1)
    found = lines.select(
        "key",
        "pos",
        F.max("pos").over(ahead).alias("end"),
        F.sum("words").over(ahead).alias("n"),
        F.min("hash").over(ahead).alias("least"),
        F.xxhash64(F.collect_list("hash").over(ahead)).alias("content"),
    )
    # By the words up to a line's end; a window back ends where ``min_words`` are reached.
    behind = Window.partitionBy("key").orderBy("upto").rangeBetween(-(min_words - 1), 0)
    back = lines.withColumn("upto", F.col("before") + F.col("words")).select(
        "key",
        F.min("pos").over(behind).alias("pos"),
        F.col("pos").alias("end"),
        F.sum("words").over(behind).alias("n"),
        F.min("hash").over(behind).alias("least"),
        F.xxhash64(F.collect_list("hash").over(behind)).alias("content"),
    )
    found = found.union(back)
    return found.where(F.col("n") >= min_words).drop("n")


def repeated_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """key, runs: per document with any its runs of lines, as (first, last), that stand earlier already.

    Earlier means in a document of smaller id (then hash of the text), or further up in the same. Null ids come last.
    A run is as long as its windows overlap or touch. A window found earlier costs one row, however often it
    occurs; no two positions are paired but each with the first of its kind.
    """
    found = materialise(windows(docs, id_col=id_col, text_col=text_col, min_words=min_words), "windows")
    place = F.struct(F.col("key.id").isNull().alias("no_id"), F.col("key").alias("key"), F.col("pos").alias("pos"))
    # Fingerprints selected at more than one position.
    selected = found.groupBy("least").agg(F.min(F.struct("key", "pos")).alias("one"), F.max(F.struct("key", "pos")).alias("other"), F.count("*").alias("_n"))
    candidates = materialise(spread_join(found, selected.where("one <> other").select("least", "_n"), "least"), "candidates")
    firsts = candidates.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("_n"))
    firsts = firsts.where("first <> last").select("content", "first", "_n")
    later = spread_join(candidates, firsts, "content").where(place != F.col("first")).select("key", "pos", "end")
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # A line may begin several windows; the longest says how far they reach.
    later = later.groupBy("key", "pos").agg(F.max("end").alias("end"))
    starts = later.withColumn("reached", F.max("end").over(so_far)).withColumn("starts", F.coalesce(F.col("pos") > F.col("reached") + 1, F.lit(True)))
    numbered = starts.withColumn("run", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("key").orderBy("pos")))
    runs = numbered.groupBy("key", "run").agg(F.min("pos").alias("first"), F.max("end").alias("last"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))  # at most a document's lines


def without_runs(text: Column, runs: Column) -> Column:
    """The text without the lines of its runs; nothing changes where there are none."""
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.exists(runs, lambda r: (i >= r["first"]) & (i <= r["last"])))
    return F.when(runs.isNull(), text).otherwise(F.array_join(kept, "\n"))


def marked(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Every row (``_row``) with ``runs``, the (first, last) lines of its repeated runs, or null, and ``kept``, its text without.

    Null texts stay null. Rows of the same id and text are one document and treated alike. An empty
    table gives no rows.
    """
    runs = materialise(repeated_runs(docs, id_col=id_col, text_col=text_col, min_words=min_words), "runs")
    rows = with_row(docs, key=_document_key(id_col, text_col))
    text = F.col(ROW).getField(text_col).cast("string")
    # The texts are dealt by key whatever the number of runs, so that costs are in proportion at any size.
    return rows.join(runs.hint("merge"), "key", "left").select(ROW, "runs", without_runs(text, F.col("runs")).alias("kept"))


def deduplicated(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with repeated runs taken out of the texts, as far as they repeat at either end; all rows and columns stay, empty texts too."""
    rows = marked(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    changed = F.col(ROW).withField(f"`{text_col}`", F.col("kept"))
    return row_only(rows.select(F.when(F.col("runs").isNull(), F.col(ROW)).otherwise(changed).alias(ROW)))
