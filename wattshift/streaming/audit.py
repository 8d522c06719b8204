"""What a live query holds in its state, read from its checkpoint while it runs or rests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_variables(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Operators of a query with their partitions and the newest batch: ``(operator_id, operator, partitions, newest)``."""
    return spark.read.format("state-metadata").load(checkpoint).select(
        F.col("operatorId").alias("operator_id"), F.col("operatorName").alias("operator"),
        F.col("numPartitions").alias("partitions"), F.col("maxBatchId").alias("newest")).distinct()


def state_of(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """The rows of a state variable as of the newest committed batch, or of an earlier one."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    return (reader.option("batchId", batch) if batch is not None else reader).load(checkpoint)


def waiting_windows(spark: SparkSession, checkpoint: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """Per stream of a query over closed windows: the last closed window, how many wait, the oldest and the newest of them.

    A stream whose samples are spread over several keys counts a window once.
    """
    clocks = state_of(spark, checkpoint, "clock", operator, batch).select(
        F.col("key.stream_id").alias("stream_id"), F.col("value.closed").alias("closed"))
    waiting = state_of(spark, checkpoint, "open", operator, batch).select(
        F.col("key.stream_id").alias("stream_id"), F.col("user_map_key.window_no").alias("window_no"))
    counted = waiting.groupBy("stream_id").agg(
        F.count_distinct("window_no").alias("waiting"), F.min("window_no").alias("oldest"), F.max("window_no").alias("newest"))
    return clocks.groupBy("stream_id").agg(F.max("closed").alias("closed")).join(counted, "stream_id", "left").select(
        "stream_id", "closed", F.coalesce("waiting", F.lit(0)).alias("waiting"), "oldest", "newest")
