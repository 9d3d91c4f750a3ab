"""CSV and Parquet sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyworks.schemas import FACT_KEYS, MEASURES

# File names of the three facts in a data folder.
FACT_FILES = {
    "enrolment": "enrolment.csv",
    "demographic": "demographic_updates.csv",
    "biometric": "biometric_updates.csv",
}
# Sub-folders of the three facts in an export, by the end of their names.
FACT_FOLDERS = {"enrolment": "*enrolment", "demographic": "*demographic", "biometric": "*biometric"}


def _matches(spark: SparkSession, path: str, glob: str = "*") -> list[str]:
    """Files below ``path`` that match, through the Hadoop file system; empty if there are none.

    A matching folder, as Spark writes one, stands for the part files in it.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{glob}")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in files.globStatus(pattern) or []:
        found = str(status.getPath())
        out += _matches(spark, found, "part-*") if status.isDirectory() else [found]
    return sorted(out)


def _csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """CSV files by their column names, which tasks read from the first lines; files without a first line are left out.

    A task holds one split and stops after the first line of it, so no file is read beyond its first rows. The driver
    learns the distinct headers and which files have each.
    """

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                if batch["start"][0].as_py() == 0:
                    yield batch.slice(0, 1).select(["path", "line"])
                return

    conf = {c: spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", conf["maxPartitionBytes"])
    try:
        lines = spark.read.text(list(paths)).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
        )
        found = lines.mapInArrow(first_lines, "path string, line string").groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", conf["openCostInBytes"])
    out: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(found, key=lambda r: r["paths"][0]):
        names = tuple(next(csv.reader([row["line"].lstrip("\ufeff").rstrip("\r")]), []))
        if names:
            out.setdefault(names, []).extend(row["paths"])
    return out


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def load_datasets(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The three named CSV files (or folders of parts) of a data folder, every column as text."""
    missing = [name for name in FACT_FILES.values() if not _matches(spark, data_dir, name)]
    if missing:
        raise FileNotFoundError(f"{data_dir} lacks {', '.join(missing)}")
    return {fact: load_csv_folder(spark, data_dir, name) for fact, name in FACT_FILES.items()}


def load_csv_folder(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """All CSV files of a folder below each other, matched by column name.

    Files with the same header are read as one scan; columns a file lacks are null. Files that are empty
    give no rows; a folder of such alone is an error.
    """
    paths = _matches(spark, folder, glob)
    if not paths:
        raise FileNotFoundError(f"No CSV files found in {folder}")
    out = None
    for header, files in headers(spark, paths).items():
        rows = _csv(spark, files, _text_schema(header))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"No CSV file in {folder} has a header")
    return out


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns in {what} data: {missing}")
    return df


def fact_folder(spark: SparkSession, data_path: str, fact: str, folder: str | None = None) -> str:
    """Path of one fact's folder: ``folder`` below ``data_path``, or the one whose name ends as ``FACT_FOLDERS`` says.

    More than one such folder is an error, as the same rows might be counted twice.
    """
    root = data_path.rstrip("/")
    if folder is not None:
        return f"{root}/{folder}"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{FACT_FOLDERS[fact]}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    folders = sorted(str(s.getPath()) for s in found if s.isDirectory())
    if not folders:
        raise FileNotFoundError(f"No folder {FACT_FOLDERS[fact]} in {data_path}")
    if len(folders) > 1:
        raise ValueError(f"Several folders for {fact}: {', '.join(folders)}; name one")
    return folders[0]


def load_fact(spark: SparkSession, data_path: str, fact: str, folder: str | None = None) -> DataFrame:
    """All CSV files of one fact's folder (:func:`fact_folder`), with its columns checked at plan time."""
    rows = load_csv_folder(spark, fact_folder(spark, data_path, fact, folder))
    return require_columns(rows, FACT_KEYS + MEASURES[fact], fact)


def load_enrolment(spark: SparkSession, data_path: str, folder: str | None = None) -> DataFrame:
    return load_fact(spark, data_path, "enrolment", folder)


def load_demographic(spark: SparkSession, data_path: str, folder: str | None = None) -> DataFrame:
    return load_fact(spark, data_path, "demographic", folder)


def load_biometric(spark: SparkSession, data_path: str, folder: str | None = None) -> DataFrame:
    return load_fact(spark, data_path, "biometric", folder)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite", order_by: Sequence[str] = ()) -> str:
    """CSV folder; ``order_by`` sorts across the files, e.g. by date."""
    if order_by:
        df = df.orderBy(*order_by)
    df.write.mode(mode).option("header", True).csv(path)
    return path


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet hand-off between stages.

    Rows of one partition value are brought together per task, spread over several tasks
    by AQE when a value is large, so the number of files does not multiply.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def save_by_month(df: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> str:
    """Parquet with one folder per month, so that date filters prune folders."""
    return save_stage(df.withColumn("month", F.date_format(date, "yyyy-MM")), path, ["month"], mode)


def load_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet stage."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def load_csv_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV stage, with dates parsed by the declared schema."""
    return _csv(spark, path, schema)

