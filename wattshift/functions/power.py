"""Power metrics, time mapping and index arithmetic as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event time of sample 0. A base above the epoch keeps the first timers and windows usable.
BASE_MS = 1_577_836_800_000  # 2020-01-01T00:00:00Z


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column, b: int | Column) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def instant_power(voltage="voltage", current="current") -> Column:
    return _col(voltage) * _col(current)


def slot_index(i="i", w1: int = 1000) -> Column:
    return F.pmod(_col(i), F.lit(w1).cast("long"))


def batch_tag(i="i", w1: int = 1000) -> Column:
    return int_div(_col(i), w1).cast("long")


def event_time(i="i") -> Column:
    """The sample index read as milliseconds after the base time."""
    return F.timestamp_millis(_col(i) + F.lit(BASE_MS))


def active_power(sum_vi: Column, n: Column) -> Column:
    return sum_vi / n


def apparent_power(sum_vv: Column, sum_cc: Column, n: Column) -> Column:
    return F.sqrt(sum_vv / n) * F.sqrt(sum_cc / n)


def reactive_power(s: Column, p: Column) -> Column:
    """NaN where rounding makes the difference of squares negative."""
    return F.sqrt(s * s - p * p)


def safe_ln(x: Column) -> Column:
    """Natural log with IEEE results at and below zero, where Spark's ``ln`` gives NULL."""
    return (
        F.when(x > 0, F.ln(x))
        .when(x == 0, F.lit(float("-inf")))
        .when(x.isNotNull(), F.lit(float("nan")))
    )


def euclidean(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def event_midpoint(start: Column, end: Column) -> Column:
    return int_div(start + end, 2)


def shift_indices(indices: Column, by: Column | int) -> Column:
    offset = F.lit(by) if isinstance(by, int) else by
    return F.transform(indices, lambda x: x + offset)
