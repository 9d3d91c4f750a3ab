"""Stage tables: cut lineage and scan the facts only once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables: the one the cluster names in ``spark.checkpoint.dir``.

    Without that setting it is a folder in the session's warehouse, which a cluster shares too; unless that lies on
    the machines' own disks, where one would not find what another wrote. That is an error but on a single machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get(WAREHOUSE_CONF).rstrip("/")
    on_own_disk = warehouse.startswith("file:") or "://" not in warehouse and not warehouse.startswith("hdfs:")
    if on_own_disk and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_CONF} to a folder that all machines share; {warehouse} is on each one's own disk")
    return f"{warehouse}/_stages/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A path nothing was written to before."""
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back.

    For a result several branches of a plan need, far smaller than what it is made from.
    It outlives lost executors, can be pruned and filtered in the scan, and its size is
    known, so Catalyst broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
