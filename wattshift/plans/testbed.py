"""Signal views over the given ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import batch_tag, int_div
from wattshift.operators.ordering import number_rows
from wattshift.session import settle

PARAMS = DetectorParams(w1=20, w2=100, partition=202, eps=0.1)
BLOCK = 25  # features per window in the relational clustering queries
# Computed like any stream key: a literal would be folded out of the plans under test.
ONE_STREAM = "user_id * 0"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _samples(df: DataFrame, stream: str) -> DataFrame:
    return df.select(
        F.expr(stream).alias("stream_id"),
        F.col("event_id").alias("i"),
        F.col("value").alias("voltage"),
        F.get_json_object("props", "$.k").cast("double").alias("current"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the samples of one stream."""
    return _samples(events(spark, sf_dir), ONE_STREAM).withColumn(
        "batch_no", batch_tag("i", PARAMS.w1)
    )


# Index of an event in the signal with holes: every eighth sample is missing, and three whole
# windows after every thousand events.
GAPPY_INDEX = f"event_id + event_id div 7 + (event_id div 1000) * {3 * PARAMS.w1}"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, placed so that samples and whole windows are missing between them."""
    rows = events(spark, sf_dir).withColumn("event_id", F.expr(GAPPY_INDEX))
    return _samples(rows, ONE_STREAM).withColumn("batch_no", batch_tag("i", PARAMS.w1))


def signal_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four streams by user, each re-indexed without holes; settled, since all readers share the numbering."""
    rows = _samples(events(spark, sf_dir), "user_id % 4").withColumnRenamed("i", "at")
    return settle(
        number_rows(rows, ["stream_id"], ["at"], int_div(F.col("at"), 65536), "i")
        .drop("at")
        .withColumn("batch_no", batch_tag("i", PARAMS.w1))
    )
