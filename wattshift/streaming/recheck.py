"""The re-check of pending events as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import event_time


def stream_recheck_points(features: DataFrame, results: DataFrame, params: DetectorParams, lag: int = 1000) -> DataFrame:
    """Features at which a pending event is due for its check, ``2 * (w2 + 1)`` after its end.

    Time is the feature number, in both streams: an event is reported at most ``w2 + 1`` features behind its end, so the feature it
    waits for lies in a bounded interval behind the report, and Spark drops either side's rows once the watermarks have passed it. ``lag``
    is by how many features one stream or one side may be behind another; rows that lag more are late.
    """
    wait, detection = 2 * (params.w2 + 1), params.w2 + 1
    left = features.withColumn("at", event_time("idx")).withWatermark("at", f"{lag} milliseconds")
    # Every result moves the watermark, events or not.
    timed = results.withColumn("reported", event_time("s")).withWatermark("reported", f"{lag} milliseconds")
    events = timed.filter("d").select(F.col("stream_id").alias("event_stream"), (F.col("event_end") + wait).alias("due"), "reported")
    between = f"at >= reported + interval {wait - detection} milliseconds and at <= reported + interval {wait} milliseconds"
    return left.join(events, (F.col("stream_id") == F.col("event_stream")) & (F.col("idx") == F.col("due")) & F.expr(between), "left_semi").drop("at")
