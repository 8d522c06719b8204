"""Replaying a sample table as a stream of wire files, for the test-bed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import int_div
from wattshift.session import scratch_path, settle
from wattshift.sources.samples import end_marks, to_batches

ROWS_PER_FILE = 2_000_000
BASE_TIME = 1_600_000_000_000   # arrival of the first step of a timed replay, milliseconds


def write_replay(
    spark: SparkSession, samples: DataFrame, params: DetectorParams, steps: int = 3,
    shuffle_within: int = 0, label: str = "replay",
) -> tuple[str, int]:
    """Write samples as wire files in arrival order, the end marks last; returns the folder and files per step.

    The table is written in one pass, in steps of at most about ``ROWS_PER_FILE`` rows; each step is one file, and
    file times follow the steps, so any grouping of files into micro-batches keeps the order of arrival. With
    ``shuffle_within`` samples arrive up to that many windows late.
    """
    arrival = F.col("batch_no")
    if shuffle_within:
        # Every sample is held back by a fixed, hashed number of windows.
        arrival = arrival + F.pmod(F.xxhash64("stream_id", "i"), F.lit(shuffle_within + 1))
    placed = settle(samples.withColumn("batch_no", arrival))
    bounds = placed.agg(F.max("batch_no").alias("last"), F.count(F.lit(1)).alias("rows")).first()
    if not bounds["rows"]:
        path = scratch_path(spark, label)
        spark.createDataFrame([], "value string").write.text(path)
        return path, 1
    steps = steps_of(int(bounds["rows"]), steps)
    span = int(bounds["last"]) // steps + 1
    step = int_div(F.col("batch_no"), span).cast("int").alias("step")
    texts = to_batches(placed.filter("batch_no >= 0"), [step, "stream_id"]).select("step", "value")
    return write_timed(spark, texts.unionByName(end_marks(placed, [F.lit(steps).alias("step")])), [], label), 1


def steps_of(rows: int, least: int = 3) -> int:
    """Files of a replay, so that a micro-batch does not grow with the table."""
    return max(least, -(-rows // ROWS_PER_FILE))


def write_timed(spark: SparkSession, texts: DataFrame, keys: list[str], label: str = "timed", spacing: int = 60_000) -> str:
    """Write rows with a column ``step`` as files that arrive ``spacing`` milliseconds apart from step to step; returns a path to read.

    Rows of one step and of equal keys are in one file, so that the order in which files of one step are taken does not matter. File
    times are set through the file system, since the source reads by them.
    """
    path = scratch_path(spark, label)
    texts.repartition("step", *keys).select("step", "value").write.partitionBy("step").text(path)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            step = int(folder.getPath().getName().split("=")[1])
            for file in fs.listStatus(folder.getPath()):
                fs.setTimes(file.getPath(), BASE_TIME + step * spacing, -1)
    return f"{path}/step=*"
