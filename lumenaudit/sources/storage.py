"""Intermediate rows in storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a local session may go without that setting: executors elsewhere wouldn't see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenaudit-")
    return f"{base.rstrip('/')}/lumenaudit-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where there are fewer splits than twice the cores, so only tables that are small for the cluster: one row group is one task, whatever its splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once and read by column: what several branches of a plan need isn't computed for each, and a lost executor costs no recomputation of it. They go when the session ends."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    atexit.register(drop, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a shared folder."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone: its folder is the cluster's to clean  # noqa: BLE001
        return
