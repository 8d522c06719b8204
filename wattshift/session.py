"""Shared storage helpers: reliable checkpoints, scratch folders of a run and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set in local mode only: on a cluster
    executors could not see it, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    fallback = tempfile.mkdtemp(prefix="wattshift-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one; all scratch data is in it."""
    return f"{shared_dir(spark)}/wattshift-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the run's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove the run's folder. Results that still read from it must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a reliable checkpoint.

    Used where a small derived table feeds several branches of a plan, so that the scan
    behind it runs once and a lost executor costs no recomputation of it. Checkpoints belong
    to the application: ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark remove
    them when they are no longer referenced.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)
