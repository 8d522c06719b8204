"""The detector as SQL table functions on Arrow batches.

``detect_steps`` reads a series in order and returns a result per feature; one series is one partition, of which a slice is in memory.
``detect_maps`` summarises one chunk, so that a long series is judged in parallel: the maps are composed and the events of the true
chain are selected by ``detect_udtf``. Either way the kernel sees every feature once (chunks repeat their context).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

from wattshift.config import DetectorParams
from wattshift.operators.detect import SUMMARY, every_result, events_of, moves_of, summary_of, with_context
from wattshift.session import settle

RESULT = "stream_id long, s long, d boolean, event_s long, event_start long, event_end long"
MAPS = ", ".join(["stream_id long"] + [f"{c} {t}" for c, t in SUMMARY.items()])
_RESULT_ARROW = pa.schema([("stream_id", pa.int64()), ("s", pa.int64()), ("d", pa.bool_()), ("event_s", pa.int64()), ("event_start", pa.int64()), ("event_end", pa.int64())])
_MAPS_ARROW = pa.schema([("stream_id", pa.int64()), ("chunk", pa.int64()), ("exits", pa.list_(pa.int32())), ("t", pa.int64()), ("new_start", pa.int64()),
                         ("first", pa.int64()), ("last", pa.int64()), ("mask", pa.list_(pa.int64()))])


def steps_function(params: DetectorParams):
    """Table function over ``(stream_id, idx, f1, f2)`` partitioned by stream and ordered by ``idx``."""
    from wattshift.streaming.processors import SignalProcessor

    @arrow_udtf(returnType=RESULT)
    class Steps:
        def __init__(self):
            self.detector, self.carried = SignalProcessor(params, detect=True), (0, 0, b"")

        def eval(self, rows: pa.RecordBatch):
            for at in range(0, rows.num_rows, params.partition):
                part = rows.slice(at, params.partition).to_pandas()
                count, start, recent = self.carried
                out, start, recent = self.detector._detect(part[["f1", "f2"]].to_numpy(float), count, start, recent)
                self.carried = (count + len(part), start, recent)
                out.insert(0, "stream_id", part["stream_id"].to_numpy())
                yield pa.Table.from_pandas(out, _RESULT_ARROW, preserve_index=False)

    return Steps


def maps_function(params: DetectorParams):
    """Table function over ``(stream_id, chunk, idx, f1, f2)`` partitioned by stream and chunk: the chunk's transfer map and chain moves."""
    summary = summary_of(params, ["stream_id"], resets=False)

    @arrow_udtf(returnType=MAPS)
    class Maps:
        def __init__(self):
            self.rows = []

        def eval(self, rows: pa.RecordBatch):
            self.rows.append(rows)
            return iter(())

        def terminate(self):
            if self.rows:
                chunk = pa.Table.from_batches(self.rows).to_pandas()
                out = summary((int(chunk["stream_id"].iloc[0]), int(chunk["chunk"].iloc[0])), chunk[["idx", "f1", "f2"]])
                yield pa.Table.from_pandas(out, _MAPS_ARROW, preserve_index=False)

    return Maps


def register(spark: SparkSession, params: DetectorParams, steps: str = "detect_steps", maps: str = "detect_maps") -> None:
    spark.udtf.register(steps, steps_function(params))
    spark.udtf.register(maps, maps_function(params))


def detect_udtf(features: DataFrame, params: DetectorParams) -> DataFrame:
    """All results through SQL, chunks in parallel."""
    spark = features.sparkSession
    register(spark, params)
    chunks = with_context(features, params).select("stream_id", "chunk", "idx", "f1", "f2")
    maps = settle(spark.sql(
        "SELECT * FROM detect_maps(TABLE({chunks}) PARTITION BY (stream_id, chunk) ORDER BY idx)", chunks=chunks))
    return every_result(features, events_of(moves_of(maps, params)))


def detect_steps(features: DataFrame, params: DetectorParams) -> DataFrame:
    """All results through SQL, a series at a time."""
    spark = features.sparkSession
    register(spark, params)
    return spark.sql("SELECT * FROM detect_steps(TABLE({rows}) PARTITION BY stream_id ORDER BY idx)",
                     rows=features.select("stream_id", "idx", "f1", "f2"))
