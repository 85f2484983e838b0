"""Cutting lineage of iterative jobs in the cluster's shared folder, and joins with a side of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is sent to all executors.
SENT_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for written tables: the cluster's, or one beside the warehouse. A warehouse
    on the driver's own disk is shared in local mode only, so a cluster without a folder is told to name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named, warehouse = sc.getConf().get("spark.checkpoint.dir"), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not named and not sc.master.startswith("local[") and sc.master != "local" and (warehouse.startswith(("/", "file:")) or "://" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write a table once in the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A written table that a join sends to all executors if its counted rows are few, else shuffles."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= most else df
