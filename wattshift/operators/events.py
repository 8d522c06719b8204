"""Event model on clustered windows: candidates, loss, selection, backward pass.

Every operator works on all windows at once and is keyed by the window columns ``keys``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.operators import kernel
from wattshift.operators.clustering import (
    NOISE,
    cluster_assign,
    cluster_guard,
    cluster_stats,
    dense_clusters,
    window_arrays,
)
from wattshift.session import settle


WINDOWS_AT_ONCE = 500  # windows that detect_window judges in one kernel run

def cluster_pairs(stats: DataFrame, keys: list[str]) -> DataFrame:
    """All unordered pairs of a window's clusters, ``c1`` starting first."""
    one = stats.select(*keys, F.col("cluster_id").alias("c1"), F.col("u").alias("u1"), F.col("v").alias("v1"))
    two = stats.select(*keys, F.col("cluster_id").alias("c2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    return one.join(two, keys).filter(F.col("c1") < F.col("c2"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that do not interleave: the first ends before the second starts."""
    return pairs.filter(F.col("v1") < F.col("u2"))


def event_intervals(pairs: DataFrame, noise: DataFrame, keys: list[str]) -> DataFrame:
    """Noise positions strictly between the two clusters; pairs without any drop out."""
    inner = noise.select(*keys, F.col("pos").alias("at"))
    return (
        pairs.join(inner, keys)
        .filter((F.col("at") > F.col("v1")) & (F.col("at") < F.col("u2")))
        .groupBy(*keys, "c1", "c2")
        .agg(F.sort_array(F.collect_list("at")).alias("interval"))
    )


def event_bounds(candidates: DataFrame) -> DataFrame:
    """First and last position of each interval."""
    return candidates.withColumn("first", F.array_min("interval")).withColumn(
        "last", F.array_max("interval")
    )


def event_candidates(assigned: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Cluster pairs that satisfy the event model, with their intervals."""
    stats = cluster_stats(assigned, keys)
    dense = dense_clusters(stats, params).join(
        cluster_guard(stats, keys, params).select(*keys), keys, "left_semi"
    )
    noise = assigned.filter(F.col("cluster_id") == NOISE)
    return event_intervals(ordered_pairs(cluster_pairs(dense, keys)), noise, keys)


def candidate_loss(candidates: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Members on the wrong side of, or inside, each candidate's interval."""
    bounded = event_bounds(candidates)
    sides = bounded.withColumn("low", F.col("first") - 1).withColumn("high", F.col("last") + 1)
    role = F.explode(
        F.array(
            F.struct(F.col("c1").alias("cluster_id"), F.lit(1).alias("side")),
            F.struct(F.col("c2").alias("cluster_id"), F.lit(2).alias("side")),
        )
    )
    pos, low, high, side = F.col("pos"), F.col("low"), F.col("high"), F.col("side")
    return (
        sides.withColumn("role", role)
        .select(*keys, "c1", "c2", "first", "last", "low", "high", "role.*")
        .join(assigned.select(*keys, "cluster_id", "pos"), [*keys, "cluster_id"])
        .groupBy(*keys, "c1", "c2", "first", "last")
        .agg(
            F.count_if((side == 2) & (pos <= low)).alias("a"),
            F.count_if((side == 1) & (pos >= high)).alias("b"),
            F.count_if((pos > low) & (pos < high)).alias("c"),
        )
        .withColumn("loss", F.col("a") + F.col("b") + F.col("c"))
    )


def best_candidate(losses: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """The candidate of least loss, the first pair on ties, if the loss is acceptable."""
    return (
        losses.groupBy(*keys)
        .agg(F.min(F.struct("loss", "c1", "c2", "first", "last")).alias("best"))
        .select(*keys, "best.*")
        .filter(F.col("loss") <= params.loss_thresh)
    )


def suffix_cuts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Every suffix of every window: a point at ``pos`` belongs to cuts ``0..pos``."""
    return points.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("pos")))).select(
        *keys, "cut", *[c for c in points.columns if c not in keys]
    )


def backward_pass(points: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Event of each window after dropping leading points while one remains visible.

    ``pos`` counts from 0 in each window. The bounds are the interval's positions plus one. Only windows that show an
    event as a whole are cut further.
    """
    cut_keys = [*keys, "cut"]
    whole = settle(cluster_assign(points, keys, params))
    shown = best_candidate(candidate_loss(event_candidates(whole, keys, params), whole, keys), keys, params)
    busy = points.join(shown.select(*keys), keys, "left_semi")
    assigned = settle(cluster_assign(suffix_cuts(busy, keys), cut_keys, params))
    found = best_candidate(
        candidate_loss(event_candidates(assigned, cut_keys, params), assigned, cut_keys),
        cut_keys, params,
    )
    run = F.row_number().over(Window.partitionBy(*keys).orderBy("cut"))
    return (
        found.withColumn("run", run)
        .filter(F.col("run") == F.col("cut") + 1)
        .groupBy(*keys)
        .agg(F.max(F.struct("cut", "first", "last")).alias("kept"))
        .select(
            *keys,
            F.col("kept.cut").alias("cut"),
            (F.col("kept.first") + 1).alias("event_start"),
            (F.col("kept.last") + 1).alias("event_end"),
        )
    )


def detect_window(points: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Forward and backward pass of each window in one Arrow-batched step."""
    eps, locality = params.eps, params.min_locality

    def many(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[tuple]:
        """All windows behind one another, parted by points that are near nothing, in one kernel run."""
        reach = max(len(x) for x in xs) - 1
        if reach < 1:
            return [(None, None)] * len(xs)
        gap = np.full(reach, np.nan)
        line = [np.concatenate([part for x in values for part in (gap, x)]) for values in (xs, ys)]
        first, last = kernel.backward_pass(*kernel.window_intervals(*line, reach, eps, locality))[:2]
        ends = np.cumsum([len(x) + reach for x in xs]) - 1 - reach
        rows = []
        for x, end in zip(xs, ends):
            k = len(x) - 1
            a, b = int(first[k, end]), int(last[k, end])
            rows.append((None, None) if k < 1 or a == kernel.NONE else (k - a + 1, k - b + 1))
        return rows

    @F.pandas_udf("struct<event_start:int,event_end:int>")
    def judge(f1: pd.Series, f2: pd.Series) -> pd.DataFrame:
        xs, ys = ([np.asarray(v, float) for v in f] for f in (f1, f2))
        rows = [r for at in range(0, len(xs), WINDOWS_AT_ONCE) for r in many(xs[at: at + WINDOWS_AT_ONCE], ys[at: at + WINDOWS_AT_ONCE])]
        return pd.DataFrame(rows, columns=["event_start", "event_end"]).astype("Int32")

    return (
        window_arrays(points, keys)
        .withColumn("event", judge("points.f1", "points.f2"))
        .select(*keys, "event.*")
        .filter("event_start is not null")
    )
