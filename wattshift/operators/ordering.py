"""Ordered operations that stay parallel inside one long stream.

A window function partitioned by stream alone would put a whole stream into one task. The
helpers here split each stream into blocks of its order key, work inside the blocks, and
carry only one small row per block across them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshift.functions.power import int_div


def join_blocks(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Join a block's rows with what precedes the block; a null key is a key like any other."""
    names = {k: f"_start{n}" for n, k in enumerate(keys)}
    right = starts.withColumnsRenamed(names)
    return rows.join(right, reduce(and_, [rows[k].eqNullSafe(right[n]) for k, n in names.items()])).drop(*names.values())


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "idx"
) -> DataFrame:
    """Add the dense 0-based number of each row within ``keys``, in ``order``.

    ``block`` must not decrease along ``order``. ``df`` is read by two branches; settle it
    first when it is expensive.
    """
    blocked = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        join_blocks(blocked.withColumn("_place", F.row_number().over(inside)), starts, [*keys, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_block", "_before", "_place")
    )


def row_chunks(
    df: DataFrame, keys: list[str], order: list[str], size: int, block: Column,
    piece: int = 1_000_000,
) -> DataFrame:
    """Number the rows of each key in order and cut them into chunks of ``size`` rows.

    Equal rows are counted where they meet, in the one exchange by key and block, and dealt out
    again in pieces, so a value that is copied very often neither sorts nor expands inside one task.
    """
    spread = df.withColumn("_block", block).repartition(*keys, "_block")
    blocked = spread.groupBy(*df.columns, "_block").agg(F.count(F.lit(1)).alias("_copies"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_copies").alias("_rows"))
        .select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = blocked.withColumn("_ahead", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    placed = join_blocks(ahead, starts, [*keys, "_block"]).withColumn("_first", F.col("_before") + F.col("_ahead"))
    pieces = placed.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), int_div(F.col("_copies") - 1, piece)))
    )
    # Only rows with more than one piece need to move before they expand.
    single = pieces.filter(F.col("_copies") <= piece)
    many = pieces.filter(F.col("_copies") > piece).repartition(*keys, *order, "_piece")
    low = F.col("_piece") * piece
    high = F.least(F.col("_copies"), low + piece) - 1
    return (
        single.unionByName(many)
        .withColumn("_copy", F.explode(F.sequence(low, high)))
        .withColumn("row_no", (F.col("_first") + F.col("_copy")).cast("long"))
        .withColumn("chunk", int_div(F.col("row_no"), size).cast("long"))
        .select(*df.columns, "row_no", "chunk")
    )
