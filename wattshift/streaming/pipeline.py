"""Streaming queries: windows, gap filling, detection, ordered release.

Input streams are decoded samples ``(stream_id, batch_no, i, voltage, current, ended, ts)``; a row with ``ended`` is the
stream's end mark. Every stream has a clock of its own, the number of its newest batch: a stream that lags behind others
loses nothing, and its end closes no other.

Rows are packed before the shuffle: sums per window where nothing has to be filled, arrays of readings per slot group
otherwise. So a stream's samples are spread over ``groups`` keys, and the key of the whole stream sees one
small row per closed window and group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.session import scratch_path
from wattshift.streaming.processors import (
    FEATURE_SCHEMA,
    PART_SCHEMA,
    RESULT_SCHEMA,
    EventTimeSorter,
    SignalProcessor,
    SlotSums,
    WindowSums,
)

GROUPS = 8   # keys over which the samples of one stream are spread

_CLOCK = "stream_id long, grp long, clock long, ended boolean, arrived long, "
PACKED_SUMS = _CLOCK + "window_no array<long>, n array<long>, sum_vi array<double>, sum_vv array<double>, sum_cc array<double>"
PACKED_READINGS = _CLOCK + "i array<long>, batch array<long>, voltage array<double>, current array<double>"


def stateful_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application set up for keyed state.

    State partitions are fixed for the life of a query and each is committed in every micro-batch, whether it has input or not.
    So they follow the cluster's cores and not the shuffle setting, which follows the size of tables, unless a number is given.
    """
    session = spark.newSession()
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )
    session.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def _usable(rows: pd.DataFrame) -> pd.DataFrame:
    """Samples without a null; end marks and unreadable samples are not among them."""
    return rows[rows[["i", "voltage", "current"]].notna().all(axis=1)]


def _pack_sums(w1: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, rows in batch.groupby("stream_id"):
                good = _usable(rows)
                v, c = good["voltage"].to_numpy(float), good["current"].to_numpy(float)
                window, at = np.unique(good["i"].to_numpy(np.int64) // w1, return_inverse=True)
                sums = [np.bincount(at, x, len(window)).tolist() for x in (v * c, v * v, c * c)]
                out.append((stream, 0, rows["batch_no"].max(), bool(rows["ended"].any()), rows["arrived"].max(), window.tolist(), np.bincount(at, minlength=len(window)).tolist(), *sums))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PACKED_SUMS.split(", ")])
    return run


def _pack_readings(w1: int, groups: int, by_window: bool):
    """Every group of a stream gets the clock, also where no sample is its own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, rows in batch.groupby("stream_id"):
                good = _usable(rows)
                i = good["i"].to_numpy(np.int64)
                group = (i // w1 if by_window else i % w1) % groups
                values = [i, *[good[c].to_numpy() for c in ("batch_no", "voltage", "current")]]
                for g in range(groups):
                    own = group == g
                    out.append((stream, g, rows["batch_no"].max(), bool(rows["ended"].any()), rows["arrived"].max(), *[x[own].tolist() for x in values]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PACKED_READINGS.split(", ")])
    return run


def _pack(samples: DataFrame, packer, schema: str) -> DataFrame:
    arrived = F.unix_millis("arrived") if "arrived" in samples.columns else F.lit(0).cast("long")
    columns = samples.filter("stream_id is not null and batch_no is not null").select(
        "stream_id", "batch_no", "i", "voltage", "current", "ended", arrived.alias("arrived"))
    return columns.mapInPandas(packer, schema)


@dataclass(frozen=True)
class Idle:
    """When a stream counts as stopped: no input for ``millis``.

    Time is that of arrival (column ``arrived`` of the samples), which goes on with the input of other streams and is the same in
    every replay, or with ``wall_clock`` that of the machine, which goes on without any input.
    """

    millis: int
    wall_clock: bool = False

    @property
    def time_mode(self) -> str:
        return "ProcessingTime" if self.wall_clock else "EventTime"


def closed_windows(
    samples: DataFrame, params: DetectorParams, delay_windows: int = 1, fill: bool = False, groups: int = GROUPS,
    idle: Idle | None = None, marks: bool = False,
) -> DataFrame:
    """Shares of each tumbling window once the stream's clock closes it (``PART_SCHEMA``).

    ``delay_windows`` is how many windows a sample may lag behind the newest one: 1 for
    ordered input, ``max_latency + 1`` for out-of-order input. Later samples are dropped. With ``idle`` a stream that stops
    without an end mark closes its windows after that time.
    """
    if idle and not idle.wall_clock:
        samples = samples.withWatermark("arrived", "0 seconds")
    timing = (idle.millis, not idle.wall_clock) if idle else (None, True)
    if fill:
        packed = _pack(samples, _pack_readings(params.w1, groups, by_window=False), PACKED_READINGS)
        processor = SlotSums(params, groups, delay_windows, *timing)
    else:
        packed, processor = _pack(samples, _pack_sums(params.w1), PACKED_SUMS), WindowSums(delay_windows, *timing, marks)
    return packed.groupBy("stream_id", "grp").transformWithStateInPandas(
        processor, PART_SCHEMA, "append", idle.time_mode if idle else "none")


def signal_features(
    samples: DataFrame, params: DetectorParams, delay_windows: int = 1, fill: bool = True
) -> DataFrame:
    """Numbered features, short windows filled with last-known values."""
    return closed_windows(samples, params, delay_windows, fill).groupBy("stream_id").transformWithStateInPandas(
        SignalProcessor(params, detect=False), FEATURE_SCHEMA, "append", "none")


def tumbling(samples: DataFrame, params: DetectorParams, delay_windows: int = 1, idle: Idle | None = None) -> DataFrame:
    """Power point of every closed window from its own samples (no dense index)."""
    from wattshift.operators.features import feature_columns, power_columns

    powered = power_columns(closed_windows(samples, params, delay_windows, idle=idle))
    return powered.select(
        "stream_id", F.col("first_window").alias("window_no"), *feature_columns(powered, params), F.col("n").alias("size")
    )


def signal_results(
    samples: DataFrame, params: DetectorParams, delay_windows: int = 1, fill: bool = True
) -> DataFrame:
    """One detection result per feature, as soon as its window closes."""
    return closed_windows(samples, params, delay_windows, fill).groupBy("stream_id").transformWithStateInPandas(
        SignalProcessor(params, detect=True), RESULT_SCHEMA, "append", "none")


def sort_by_event_time(
    samples: DataFrame, params: DetectorParams, delay_windows: int, groups: int = GROUPS, late: bool = False
) -> DataFrame:
    """Samples of each window released in event-time order behind the stream's clock; with ``late`` also those that come too late,
    in a column that says so."""
    packed = _pack(samples, _pack_readings(params.w1, groups, by_window=True), PACKED_READINGS)
    schema = "stream_id long, i long, voltage double, current double" + ", late boolean" * late
    return packed.groupBy("stream_id", "grp").transformWithStateInPandas(EventTimeSorter(params, delay_windows, late), schema, "append", "none")


def write_late_apart(sorted_rows: DataFrame, used: str, late: str, checkpoint: str):
    """Two outputs of one pass over samples with a mark ``late``; returns the unstarted writer.

    The progress of every micro-batch tells how many rows were used and late (observed metrics ``lateness``). Rows of a batch go to a
    folder of its own, so a repeated batch replaces what it had written.
    """
    counted = sorted_rows.observe("lateness", F.count_if(~F.col("late")).alias("used"), F.count_if(F.col("late")).alias("late"))

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for path, rows in ((used, batch.filter("not late")), (late, batch.filter("late"))):
                rows.drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return counted.writeStream.foreachBatch(route).outputMode("append").option("checkpointLocation", checkpoint)


def run_available(writer) -> None:
    """Start a stream writer over everything available and wait for its end."""
    writer.trigger(availableNow=True).start().awaitTermination()


def run_to_files(result: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Run a streaming query over everything available and read its output back."""
    out = scratch_path(spark, label)
    run_available(
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
    )
    return spark.read.schema(result.schema).parquet(f"{out}/rows")
