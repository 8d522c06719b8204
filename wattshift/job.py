"""The whole job: a folder of wire files in, a folder of results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattshift.config import DetectorParams
from wattshift.sources import samples as src
from wattshift.sources.results import RESULT_FIELDS, print_results, stream_results
from wattshift.streaming import pipeline as pl


def run(spark: SparkSession, source: str, target: str, late: bool = False, params: DetectorParams = DetectorParams(),
        debug: bool = False, files_per_trigger: int = 1) -> None:
    """Detect over everything in ``source`` and write one JSON result per feature below ``target``.

    Ordered input closes a window with the next batch; with ``late`` samples may lag ``max_latency`` batches and missing
    ones are filled with the last known values. Unreadable texts and records go to ``target/quarantine``, results to
    ``target/results``, state to ``target/state``; a second call goes on from there. ``debug`` prints the results that this call has written.
    """
    session = pl.stateful_session(spark)
    texts = src.stream_texts(session, source, files_per_trigger)
    pl.run_available(src.quarantine(texts).writeStream.format("json").outputMode("append")
                     .option("path", f"{target}/quarantine").option("checkpointLocation", f"{target}/state/quarantine"))
    delay = params.max_latency + 1 if late else 1
    results = pl.signal_results(src.stream_batches(session, source, files_per_trigger), params, delay, fill=late)
    pl.run_available(stream_results(results, f"{target}/results", f"{target}/state/results"))
    if debug:
        written = session.readStream.schema(RESULT_FIELDS).json(f"{target}/results")
        pl.run_available(print_results(written).option("checkpointLocation", f"{target}/state/debug"))


def results(spark: SparkSession, target: str) -> DataFrame:
    from wattshift.sources.results import read_results

    return read_results(spark, f"{target}/results")
