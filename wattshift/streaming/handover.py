"""From history to live: a stream goes on where a batch run over the past ended.

The batch run leaves per stream its last closed window, the number of its features, where the detection window starts and the last ``w2``
features. These become the initial state of the live query, so history is not replayed; samples of its windows that arrive again are late.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.operators.detect import window_moves
from wattshift.session import settle
from wattshift.streaming import pipeline as pl
from wattshift.streaming.processors import PART_SCHEMA, RESULT_SCHEMA, SignalProcessor, WindowSums


class ResumedWindowSums(WindowSums):
    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.clock.update((int(initialState["closed"].iloc[0]),))


class ResumedSignal(SignalProcessor):
    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        recent = np.stack([np.asarray(r["f1"], float), np.asarray(r["f2"], float)], 1)
        self.state.update((int(r["count"]), int(r["start"]), np.ascontiguousarray(recent).tobytes()))


def history_state(features: DataFrame, params: DetectorParams) -> DataFrame:
    """(stream_id, closed, count, start, f1, f2) at the end of a series with dense ``idx`` and ``window_no``; small: one row a stream."""
    ends = features.groupBy("stream_id").agg(F.max("window_no").alias("closed"), (F.max("idx") + 1).alias("count"))
    starts = window_moves(features, params).groupBy("stream_id").agg(F.max_by("new_start", "idx").alias("start"))
    last = features.join(ends, "stream_id").filter(F.col("idx") >= F.col("count") - params.w2).groupBy("stream_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "f1", "f2"))).alias("x")).select("stream_id", F.col("x.f1").alias("f1"), F.col("x.f2").alias("f2"))
    return settle(ends.join(starts, "stream_id", "left").join(last, "stream_id").select(
        "stream_id", "closed", "count", F.coalesce("start", F.lit(0)).cast("long").alias("start"), "f1", "f2"))


def results_from_history(samples: DataFrame, history: DataFrame, params: DetectorParams, delay_windows: int = 1) -> DataFrame:
    """Live results of ordered input behind ``history`` (``history_state``); a stream without history begins anew."""
    packed = pl._pack(samples, pl._pack_sums(params.w1), pl.PACKED_SUMS)
    closed = history.select("stream_id", F.lit(0).cast("long").alias("grp"), "closed").groupBy("stream_id", "grp")
    windows = packed.groupBy("stream_id", "grp").transformWithStateInPandas(
        ResumedWindowSums(delay_windows), PART_SCHEMA, "append", "none", initialState=closed)
    carried = history.select("stream_id", "count", "start", "f1", "f2").groupBy("stream_id")
    return windows.groupBy("stream_id").transformWithStateInPandas(
        ResumedSignal(params, detect=True), RESULT_SCHEMA, "append", "none", initialState=carried)
