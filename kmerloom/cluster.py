"""What every plan needs of its cluster: a shared folder for intermediate tables, durable cuts, and an even start."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one a local master uses a temporary folder; on a cluster that is an error,
    since no machine-local folder outlives its executor."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    current = context._jsc.sc().getCheckpointDir()
    return current.get() if current.nonEmpty() else tempfile.mkdtemp(prefix="kmerloom-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder; for what several branches of a plan read, and to cut long lineages.

    Spark deletes these files with the last reference to them where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan with fewer splits than cores to all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
