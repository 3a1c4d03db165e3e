"""Durable cuts of a lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    `spark.checkpoint.dir` names it on a cluster. Only where that is unset, and only on a local
    master, a temporary folder is made; on a cluster without the setting an error says so.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def durable_table(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet below the shared checkpoint folder and read again: smaller than a checkpoint and prunable. The file system deletes it when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)
