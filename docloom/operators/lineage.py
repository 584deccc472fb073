"""Cutting a plan's lineage where an operator repeats itself."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a single machine may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to the session's number of partitions: for work whose cost is not in bytes, which files and adaptive partitions are measured by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: filters on them, and uses by others, are not put in terms of what they are made of."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_bound")).select("*", "_bound.*").drop("_bound")


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """df, written to the shared folder and read again: computed once for all that use it, and of a size that the planner knows."""
    df.write.parquet(path := shared_path(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)
