"""Bounded training samples and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyworks.functions.lineage import materialise


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text; that of an empty text for null."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_cols: list[str], rows_per_class: dict[int, int], *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, text, labels): at most ``rows_per_class`` labelled texts, drawn by a hash of their id.

    ``labels`` has ``doc_id`` and a column of 0 and 1 per label. A class is 1 if any label is set. Rows
    with a null id or label are left out; of labels repeated for an id the greatest counts, and of
    documents repeated for an id one is taken. Which ids are drawn depends on them alone.
    """
    known = F.col("doc_id").isNotNull()
    for c in label_cols:
        known = known & F.col(c).isNotNull()
    one = labels.where(known).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in label_cols])
    one = one.withColumn("_class", F.greatest(*[F.col(c) for c in label_cols], F.lit(0))).withColumn("key", F.xxhash64("doc_id"))
    drawn = [one.where(F.col("_class") == k).orderBy("key", "doc_id").limit(n) for k, n in sorted(rows_per_class.items())]
    sample = drawn[0]
    for more in drawn[1:]:
        sample = sample.union(more)
    sample = materialise(sample.drop("_class"), "sample")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # The drawn ids are bounded by rows_per_class.
    joined = texts.join(F.broadcast(sample), F.col("_id") == F.col("doc_id"))
    return joined.groupBy("doc_id", "key", *label_cols).agg(F.min("text").alias("text")).drop("doc_id")


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """``fit`` of the whole sample, in one task on an executor. The sample and the model must be bounded.

    ``fit`` returns numbers, strings, arrays and collections of them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.drop(columns="_all").sort_values(["key", "text"], kind="stable").reset_index(drop=True)
        return pd.DataFrame({"model": [pickle.dumps(fit(ordered))]})

    made = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "model binary").collect()
    if made:
        return pickle.loads(made[0]["model"])
    return fit(pd.DataFrame({f.name: pd.Series([], dtype="object" if f.name == "text" else "int64") for f in sample.schema}))
