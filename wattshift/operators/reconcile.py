"""Combining provisional and verified results, look-ups by index, release rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import int_div
from wattshift.operators.detect import detect_events
from wattshift.operators.frames import overlap_partitions, overlap_suppress
from wattshift.operators.ordering import number_rows

def provisional_results(features: DataFrame, params: DetectorParams) -> DataFrame:
    """Each overlapping partition judged on its own from a fresh window, overlap answered
    by the earlier partition: one row per feature."""
    parts = overlap_partitions(features, params)
    local = parts.select(
        "stream_id", "part_key", F.col("part_offset").alias("idx"), "f1", "f2"
    )
    events = detect_events(local, params, keys=["stream_id", "part_key"]).withColumnRenamed(
        "s", "part_offset"
    )
    base = F.col("part_key") * params.partition
    judged = parts.select("stream_id", "part_key", "part_offset", F.col("idx").alias("s")).join(
        events, ["stream_id", "part_key", "part_offset"], "left"
    )
    return overlap_suppress(judged, params).select(
        "stream_id",
        "s",
        F.col("event_s").isNotNull().alias("d"),
        F.coalesce(F.col("event_s") + base, F.lit(-1).cast("long")).alias("event_s"),
        (F.col("event_start") + base).alias("event_start"),
        (F.col("event_end") + base).alias("event_end"),
    )


def reconcile_merge(provisional: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified events replace provisional results; provisional events that were not
    verified are retracted to "not detected"."""
    truth = verified.select("stream_id", "s", F.col("event_s").alias("true_s"))
    return provisional.join(truth, ["stream_id", "s"], "left").select(
        "stream_id",
        "s",
        F.col("true_s").isNotNull().alias("d"),
        F.coalesce("true_s", F.lit(-1).cast("long")).alias("event_s"),
        (F.col("d") & F.col("true_s").isNull()).alias("retracted"),
    )


def pending_minus_verified(pending: DataFrame, verified: DataFrame) -> DataFrame:
    return pending.join(verified.select("stream_id", "s"), ["stream_id", "s"], "left_anti")


def range_lookup(
    features: DataFrame, regions: DataFrame, bucket: int = 1024
) -> DataFrame:
    """Features with ``a <= idx < b`` for each region ``(stream_id, region_id, a, b)``."""
    buckets = F.sequence(int_div(F.col("a"), bucket), int_div(F.col("b") - 1, bucket))
    wanted = regions.filter(F.col("b") > F.col("a")).withColumn("_bucket", F.explode(buckets))
    return (
        features.withColumn("_bucket", int_div(F.col("idx"), bucket))
        .join(wanted, ["stream_id", "_bucket"])
        .filter((F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b")))
        .drop("_bucket")
    )


def recheck_points(features: DataFrame, events: DataFrame, params: DetectorParams) -> DataFrame:
    """Features at which a pending event is due for its check, ``2 * (w2 + 1)`` after it."""
    due = events.select(
        "stream_id", (F.col("event_end") + 2 * (params.w2 + 1)).alias("idx")
    )
    return features.join(due, ["stream_id", "idx"], "left_semi")


def latest_recheck(events: DataFrame, params: DetectorParams) -> DataFrame:
    return events.groupBy("stream_id").agg(
        (F.max("event_end") + 2 * (params.w2 + 1)).alias("latest_recheck")
    )


def release_below_bound(results: DataFrame, bounds: DataFrame) -> DataFrame:
    """Results with ``s < bound`` of their stream; a plain join, whose hot streams Spark splits."""
    return (
        results.join(bounds.select("stream_id", "bound"), "stream_id")
        .filter(F.col("s") < F.col("bound"))
        .drop("bound")
    )


def contiguous_prefix(results: DataFrame, block: int = 65_536) -> DataFrame:
    """Results released in sequence 0, 1, 2, ...: those before the stream's first hole.

    ``s`` is unique in a stream, so a row is in sequence if its number among all is its ``s``.
    """
    numbered = number_rows(results, ["stream_id"], ["s"], int_div(F.col("s"), block), "_place")
    return numbered.filter(F.col("_place") == F.col("s")).drop("_place")
