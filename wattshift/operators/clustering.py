"""Density clustering inside bounded windows of features.

Points are rows ``(*keys, pos, f1, f2)`` where ``keys`` name a window of at most a few
hundred rows. A point with no other point within ``eps`` is noise; clusters are the connected
components of the neighbour graph, numbered by their least member, noise is ``-1``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import euclidean

NOISE = -1
_SLACK = 1e-6          # grid cells slightly wider than eps, so rounding never skips a cell
_BATCH_PAIRS = 4_000_000
MAX_WINDOW = 2_000  # points of a window whose distances are held at once


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def eps_neighbours(points: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Ordered pairs ``(*keys, a, b, dist)`` of distinct points within ``eps``.

    An equi-join on window and grid cell: one side is placed in its own cell, the other in
    the nine cells around it, so no point meets those of distant cells.
    """
    width = params.eps * (1.0 + _SLACK)
    placed = (
        points.filter(_finite("f1") & _finite("f2"))
        .withColumn("cx", F.floor(F.col("f1") / width))
        .withColumn("cy", F.floor(F.col("f2") / width))
    )
    left = placed.select(*keys, F.col("pos").alias("a"), F.col("f1").alias("ax"),
                         F.col("f2").alias("ay"), "cx", "cy")
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    right = (
        placed.select(*keys, F.col("pos").alias("b"), F.col("f1").alias("bx"),
                      F.col("f2").alias("by"), "cx", "cy")
        .withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .withColumn("cx", F.col("cx") + F.col("dx"))
        .withColumn("cy", F.col("cy") + F.col("dy"))
        .drop("dx", "dy")
    )
    dist = euclidean(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return (
        left.join(right, [*keys, "cx", "cy"])
        .withColumn("dist", dist)
        .filter((F.col("a") != F.col("b")) & (F.col("dist") <= params.eps))
        .select(*keys, "a", "b", "dist")
    )


def noise_points(points: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Points that have no neighbour, from the labels; no pairs are made."""
    return cluster_assign(points, keys, params).filter(F.col("cluster_id") == NOISE).drop("cluster_id")


def _labels(f1: np.ndarray, f2: np.ndarray, eps: float) -> np.ndarray:
    """Cluster numbers of many equally padded windows ``[window, point]`` at once."""
    n = f1.shape[1]
    with np.errstate(invalid="ignore"):
        dx = f1[:, :, None] - f1[:, None, :]
        dy = f2[:, :, None] - f2[:, None, :]
        near = np.sqrt(dx * dx + dy * dy) <= eps
    near |= np.eye(n, dtype=bool)
    least = np.broadcast_to(np.arange(n), f1.shape)
    while True:
        spread = np.where(near, least[:, None, :], n).min(axis=2)
        spread = np.take_along_axis(spread, spread, axis=1)
        if np.array_equal(spread, least):
            break
        least = spread
    lone = near.sum(axis=2) == 1
    root = (least == np.arange(n)) & ~lone
    number = np.cumsum(root, axis=1) - 1
    return np.where(lone, NOISE, np.take_along_axis(number, least, axis=1))


def cluster_ids(xs: Column | str, ys: Column | str, params: DetectorParams) -> Column:
    """Cluster number of each point of a window, from its two coordinate arrays."""
    eps = params.eps

    @F.pandas_udf("array<int>")
    def assign(f1: pd.Series, f2: pd.Series) -> pd.Series:
        sizes = f1.str.len().to_numpy()
        out: list = [None] * len(f1)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # A run of windows whose padded distance table stays small.
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * sizes[order[stop]] ** 2 <= _BATCH_PAIRS:
                stop += 1
            rows, n = order[at:stop], int(sizes[order[stop - 1]])
            px, py = np.full((len(rows), n), np.nan), np.full((len(rows), n), np.nan)
            for r, w in enumerate(rows):
                px[r, : sizes[w]] = f1.iloc[w]
                py[r, : sizes[w]] = f2.iloc[w]
            ids = _labels(px, py, eps)
            for r, w in enumerate(rows):
                out[w] = ids[r, : sizes[w]]
            at = stop
        return pd.Series(out)

    return assign(xs, ys)


def window_arrays(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window with its points in order: ``(*keys, points[pos, f1, f2])``."""
    return points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "f1", "f2"))).alias("points")
    )


def cluster_assign(points: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Add ``cluster_id`` to every point; one shuffle, many windows per Arrow batch.

    A window is one row with a table of its distances; one of more than ``MAX_WINDOW`` points is an error.
    """
    whole = window_arrays(points, keys).withColumn("points", F.when(F.size("points") <= MAX_WINDOW, F.col("points")).otherwise(
        F.raise_error(F.lit(f"a window has more than {MAX_WINDOW} points"))))
    return (
        whole
        .withColumn("cluster_id", cluster_ids("points.f1", "points.f2", params))
        .select(*keys, F.inline(F.arrays_zip("points", "cluster_id")))
        .select(*keys, "points.*", "cluster_id")
    )


def cluster_stats(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """First and last member, size and temporal locality of each cluster (noise included)."""
    return (
        assigned.groupBy(*keys, "cluster_id")
        .agg(
            F.min("pos").alias("u"),
            F.max("pos").alias("v"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("loc", F.col("n") / (F.col("v") - F.col("u") + F.lit(1.0)))
    )


def cluster_members(assigned: DataFrame, keys: list[str]) -> DataFrame:
    return assigned.groupBy(*keys, "cluster_id").agg(
        F.sort_array(F.collect_list("pos")).alias("members")
    )


def dense_clusters(stats: DataFrame, params: DetectorParams) -> DataFrame:
    return stats.filter((F.col("cluster_id") != NOISE) & (F.col("loc") >= params.min_locality))


def cluster_guard(stats: DataFrame, keys: list[str], params: DetectorParams) -> DataFrame:
    """Windows with at least two clusters and at least two dense ones."""
    real = F.col("cluster_id") != NOISE
    return (
        stats.groupBy(*keys)
        .agg(
            F.count_if(real).alias("n_clusters"),
            F.count_if(real & (F.col("loc") >= params.min_locality)).alias("n_dense"),
        )
        .filter((F.col("n_clusters") >= 2) & (F.col("n_dense") >= 2))
    )
