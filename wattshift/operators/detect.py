"""Event detection over whole feature series, parallel inside one series.

The detector's only memory is where its current window starts, at most ``w2`` features
back. So a chunk of the series is summarised by its transfer map: for each possible window
start at its first row, the start that it hands on. One grouped pass computes, per chunk,
that map and every event that any of the chains meets. Composing the maps along the stream
(a tree of small folds) tells which chain is the true one in each chunk, and its events are
the result: the same as a sequential run, without one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import event_midpoint, int_div
from wattshift.operators import kernel
from wattshift.session import settle

WORD = 62  # chains per mask word; keeps every word a positive long

STREAM = ["stream_id"]
SUMMARY = {
    "chunk": "long", "exits": "array<int>", "t": "long", "new_start": "long",
    "first": "long", "last": "long", "mask": "array<long>",
}


def with_context(
    features: DataFrame, params: DetectorParams, keys: list[str] = STREAM
) -> DataFrame:
    """Assign features to chunks and repeat each chunk's last ``w2`` rows in the next one."""
    chunk = int_div(F.col("idx"), params.partition).cast("long")
    late = F.col("idx") % params.partition >= params.partition - params.w2
    return features.select(*keys, "idx", "f1", "f2").withColumn(
        "chunk", F.explode(F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )


def summary_of(params: DetectorParams, keys: list[str], resets: bool):
    """Function from a chunk's key and rows, context included, to its transfer map and chain moves."""
    columns = [*keys, *SUMMARY]
    w2, size = params.w2, params.partition
    eps, locality = params.eps, params.min_locality

    def run(key, pdf):
        base = int(key[-1]) * size
        pdf = pdf.sort_values("idx")
        idx = pdf["idx"].to_numpy()
        if idx[-1] < base:  # context only: the series ended with the chunk before
            return pd.DataFrame([], columns=columns)
        context = int((idx < base).sum())
        pad = np.full(w2 - context, np.nan)
        f1 = np.concatenate((pad, pdf["f1"].to_numpy(dtype=float)))
        f2 = np.concatenate((pad, pdf["f2"].to_numpy(dtype=float)))
        first, last = kernel.window_intervals(f1, f2, w2, eps, locality)
        moves, exits = kernel.follow_starts(
            first, last, w2, {-e: 1 << e for e in range(context + 1)}
        )
        ends = first.shape[1]
        handed = [0] * (w2 + 1)
        for start, mask in exits:
            for e in range(context + 1):
                if mask >> e & 1:
                    handed[e] = ends - start
        rows = [(*key, handed, None, None, None, None, None)]
        words = range(0, w2 + 1, WORD)
        for t, new_start, a, b, mask in moves:
            if a is None and not resets:
                continue
            bits = [mask >> w & ((1 << WORD) - 1) for w in words]
            rows.append((
                *key, None, base + t, base + new_start,
                None if a is None else base + a, None if b is None else base + b, bits,
            ))
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({c: "Int64" for c in ("t", "new_start", "first", "last")})

    return run


def chunk_entries(
    maps: DataFrame, params: DetectorParams, keys: list[str] = STREAM, levels: int = 2
) -> DataFrame:
    """Window start offset at the first row of every chunk: ``(*keys, chunk, entry)``.

    ``maps`` is ``(*keys, chunk, exits)``. Per level at most ``fan`` maps meet in one
    row; a group's composed map stands for it one level up, and the group's own entry then
    comes back down. The top level holds one map per ``fan ** levels`` chunks of a stream.
    """
    steps = F.sort_array(F.collect_list(F.struct("chunk", "exits")))
    if levels == 0:
        groups = maps.groupBy(*keys).agg(steps.alias("steps")).withColumn("entry", F.lit(0))
    else:
        groups = maps.groupBy(
            *keys, int_div(F.col("chunk"), params.fan).cast("long").alias("part")
        ).agg(steps.alias("steps"))
        identity = F.sequence(F.lit(0), F.lit(params.w2))
        composed = groups.select(
            *keys,
            F.col("part").alias("chunk"),
            F.aggregate(
                "steps",
                identity,
                lambda at, step: F.transform(at, lambda e: F.get(step["exits"], e)),
            ).alias("exits"),
        )
        entries = chunk_entries(composed, params, keys, levels - 1)
        groups = groups.join(entries.withColumnRenamed("chunk", "part"), [*keys, "part"])
    walked = F.aggregate(
        "steps",
        F.struct(
            F.col("entry").alias("at"),
            F.array().cast("array<struct<chunk:bigint,entry:int>>").alias("seen"),
        ),
        lambda acc, step: F.struct(
            F.get(step["exits"], acc["at"]).alias("at"),
            F.concat(
                acc["seen"],
                F.array(F.struct(step["chunk"].alias("chunk"), acc["at"].alias("entry"))),
            ).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )
    return groups.select(*keys, F.inline(walked))


def summarise_chunks(
    features: DataFrame, params: DetectorParams, keys: list[str] = STREAM, resets: bool = False
) -> DataFrame:
    """Transfer map and chain moves of every chunk, settled for the passes that follow."""
    schema = ", ".join([f"{k} long" for k in keys] + [f"{c} {t}" for c, t in SUMMARY.items()])
    spark = features.sparkSession
    # Chunks are small in bytes but not in work: a fixed count keeps adaptive execution from
    # merging them into few tasks.
    tasks = max(
        4 * spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return settle(
        with_context(features, params, keys)
        .repartition(tasks, *keys, "chunk")
        .groupBy(*keys, "chunk")
        .applyInPandas(summary_of(params, keys, resets), schema)
    )


def window_moves(
    features: DataFrame, params: DetectorParams, keys: list[str] = STREAM, resets: bool = True
) -> DataFrame:
    """Every change of the detection window: ``(*keys, idx, new_start, event_start,
    event_end)``; the event columns are NULL where a full window restarts without event."""
    return moves_of(summarise_chunks(features, params, keys, resets), params, keys)


def moves_of(chunks: DataFrame, params: DetectorParams, keys: list[str] = STREAM) -> DataFrame:
    """The moves of the true chain, from the settled transfer maps and chain moves of all chunks."""
    maps = chunks.filter("exits is not null").select(*keys, "chunk", "exits")
    entries = chunk_entries(maps, params, keys)
    taken = F.expr(
        f"shiftright(get(mask, cast(entry div {WORD} as int)), entry % {WORD}) & 1 = 1"
    )
    return (
        chunks.filter("t is not null")
        .join(entries, [*keys, "chunk"])
        .filter(taken)
        .select(
            *keys,
            F.col("t").alias("idx"),
            "new_start",
            F.col("first").alias("event_start"),
            F.col("last").alias("event_end"),
        )
    )


def detect_events(
    features: DataFrame, params: DetectorParams, keys: list[str] = STREAM
) -> DataFrame:
    """One row per detected event: ``(*keys, s, event_s, event_start, event_end)``.

    ``features`` needs a dense ``idx`` from 0 in each series; ``keys`` are long columns.
    """
    return events_of(window_moves(features, params, keys, resets=False), keys)


def events_of(moves: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """The moves that are events; ``moves`` has no others."""
    return moves.select(
        *keys,
        F.col("idx").alias("s"),
        (event_midpoint(F.col("event_start"), F.col("event_end")) + 1).alias("event_s"),
        "event_start",
        "event_end",
    )


def every_result(features: DataFrame, events: DataFrame) -> DataFrame:
    """One result row per feature; ``event_s = -1`` where nothing was detected."""
    return (
        features.select("stream_id", F.col("idx").alias("s"))
        .join(events, ["stream_id", "s"], "left")
        .select(
            "stream_id", "s",
            F.col("event_s").isNotNull().alias("d"),
            F.coalesce("event_s", F.lit(-1).cast("long")).alias("event_s"),
            "event_start", "event_end",
        )
    )


def detect_all_rows(features: DataFrame, params: DetectorParams) -> DataFrame:
    return every_result(features, detect_events(features, params))


def first_event(features: DataFrame, params: DetectorParams) -> DataFrame:
    """The first event of each stream."""
    events = detect_events(features, params)
    rest = [c for c in events.columns if c != "stream_id"]
    return (
        events.groupBy("stream_id")
        .agg(F.min(F.struct(*rest)).alias("e"))
        .select("stream_id", "e.*")
    )


def sorted_results(results: DataFrame) -> DataFrame:
    """Results in order: ranges of (stream, s) sorted in parallel."""
    return results.orderBy("stream_id", "s")
