"""Access to the Parquet tables of one data directory."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's tasks, once, so that executors needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory, a file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores.

    A large input is left as its files part it, so nothing is shuffled at scale; only a few small
    files (fewer splits than cores) are redistributed, so that Python stages use every core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all, by column name.

    Spark unites inputs that are partitioned alike partition by partition, which fails if adaptive
    execution has coalesced them to different numbers; a coalesce to more partitions than there are
    moves nothing and hides the partitioning.
    """
    loose = [df.coalesce(1_000_000) for df in (first, *others)]
    out = loose[0]
    for df in loose[1:]:
        out = out.unionByName(df)
    return out
