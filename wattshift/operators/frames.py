"""Frames over feature series: partitions with overlap, growing and trailing frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import int_div


def partition_key(features: DataFrame, params: DetectorParams) -> DataFrame:
    """Partition number and offset of each feature."""
    return features.withColumn(
        "part_key", int_div(F.col("idx"), params.partition).cast("long")
    ).withColumn("part_offset", F.col("idx") % params.partition)


def overlap_partitions(features: DataFrame, params: DetectorParams) -> DataFrame:
    """Partitions that also hold the first ``w2`` features of the next partition."""
    keyed = partition_key(features, params)
    key, offset = F.col("part_key"), F.col("part_offset")
    own = F.struct(key.alias("part_key"), offset.alias("part_offset"))
    back = F.struct((key - 1).alias("part_key"), (offset + params.partition).alias("part_offset"))
    places = F.when((offset < params.w2) & (key > 0), F.array(own, back)).otherwise(F.array(own))
    rest = [c for c in features.columns]
    return keyed.withColumn("place", F.explode(places)).select(*rest, "place.*")


def overlap_suppress(rows: DataFrame, params: DetectorParams) -> DataFrame:
    """Drop rows that the previous partition's overlap has answered already."""
    return rows.filter(~((F.col("part_key") > 0) & (F.col("part_offset") < params.w2)))


def window_points(features: DataFrame, block: int) -> DataFrame:
    """Cut series into windows of ``block`` features: ``(stream_id, window_id, pos, ...)``."""
    return features.select(
        "stream_id",
        int_div(F.col("idx"), block).cast("long").alias("window_id"),
        (F.col("idx") % block).cast("int").alias("pos"),
        "idx", "f1", "f2",
    )


def prefix_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Growing frame of each bounded window: size and range of ``f1`` up to each point."""
    frame = Window.partitionBy(*keys).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return points.select(
        *keys, "pos",
        F.count(F.lit(1)).over(frame).alias("n"),
        F.min("f1").over(frame).alias("low"),
        F.max("f1").over(frame).alias("high"),
    )


def trailing_buffer(features: DataFrame, params: DetectorParams, keep: int = 12) -> DataFrame:
    """Size and first index of the buffer of the last ``keep * w2 + 2`` features.

    Chunks carry the rows before them that their frames reach, so long series stay parallel.
    """
    length = keep * params.w2 + 2
    chunk_rows = 8 * length
    chunk = int_div(F.col("idx"), chunk_rows).cast("long")
    reaches = F.col("idx") % chunk_rows >= chunk_rows - (length - 1)
    frame = Window.partitionBy("stream_id", "chunk").orderBy("idx").rowsBetween(
        -(length - 1), Window.currentRow
    )
    return (
        features.select("stream_id", "idx")
        .withColumn("home", chunk)
        .withColumn(
            "chunk",
            F.explode(F.when(reaches, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))),
        )
        .withColumn("buffered", F.count(F.lit(1)).over(frame))
        .withColumn("first_idx", F.min("idx").over(frame))
        .filter(F.col("home") == F.col("chunk"))
        .select("stream_id", "idx", "buffered", "first_idx")
    )
