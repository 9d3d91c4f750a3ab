"""The corpus pipeline: from documents to packed sequences of tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyworks.functions.lineage import materialise
from tallyworks.llm import lines, mixing, packing, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no toxicity category is likely, by a chain trained on the labelled ones.

    Rows stay as they are, repeated ones too; a null or empty text scores what the chain says of no words, and null ids and labels teach nothing.
    """
    labels = toxicity.by_language(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    return toxicity.without_toxic(docs, toxicity.train(docs, labels, toxicity.CATEGORIES))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines of 50 words or more that stand earlier in the corpus.

    ``n_chars`` follows the text. Null texts stay null; rows of the same id and text are one document and change alike.
    """
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return lines.deduplicated(docs).withColumn("n_chars", length)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least by id, of each component of SimHash fingerprints over runs of three words that differ in at most three bits.

    Rows of null or blank text are copies of each other; null ids come last; of repeated rows one stays.
    """
    return simhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 in turn; a document comes as often as the mix takes it, up to three times.

    The null source comes last; null and blank texts have no words; repeated rows are taken alike.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their place in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("mix", mixed),
    ("pack", packed),
]

# SQL cannot express the learned stages; the tests compare the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
