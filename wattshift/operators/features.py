"""Samples to features: one 2-D power point per event-time window.

Samples are ``(stream_id, i, voltage, current[, batch_no])``; ``i`` is the event time in
milliseconds. Features are ``(stream_id, idx, window_no, f1, f2, size)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.functions.power import (
    active_power,
    apparent_power,
    batch_tag,
    int_div,
    reactive_power,
    safe_ln,
    slot_index,
)
from wattshift.operators.ordering import number_rows
from wattshift.session import settle

KEYS = ["stream_id", "window_no"]
WORD = 62                  # slots per word of a presence bitmap; keeps every word a positive long
FETCH_BROADCAST = 500_000  # carried readings up to which the list of them is broadcast, about 20 MB
SUMS = ["n", "sum_vi", "sum_vv", "sum_cc"]


def readable(samples: DataFrame) -> DataFrame:
    """Samples that can be used: a null reading, index or stream makes a sample a missing one."""
    return samples.filter(" and ".join(f"{c} is not null" for c in ("stream_id", "i", "voltage", "current")))


def unreadable(samples: DataFrame) -> DataFrame:
    """The samples that the features leave out, for quarantine."""
    return samples.filter(" or ".join(f"{c} is null" for c in ("stream_id", "i", "voltage", "current")))


def _sums() -> list[Column]:
    v, c = F.col("voltage"), F.col("current")
    return [F.count(F.lit(1)).alias("n"), F.sum(v * c).alias("sum_vi"), F.sum(v * v).alias("sum_vv"), F.sum(c * c).alias("sum_cc")]


def window_sums(samples: DataFrame, params: DetectorParams, present: bool = False) -> DataFrame:
    """Sums behind the power metrics of every tumbling window, combined before the shuffle.

    With ``present`` also ``words``, a bitmap of the slots that have a reading.
    """
    placed = readable(samples).withColumn("window_no", batch_tag("i", params.w1))
    if not present:
        return placed.groupBy(*KEYS).agg(*_sums())
    slot = slot_index("i", params.w1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % WORD).cast("int"))
    count = -(-params.w1 // WORD)
    words = [F.bit_or(F.when(int_div(slot, WORD) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{k}") for k in range(count)]
    return placed.groupBy(*KEYS).agg(*_sums(), *words).select(
        *KEYS, *SUMS, F.array(*[f"_w{k}" for k in range(count)]).alias("words"))


def power_columns(df: DataFrame) -> DataFrame:
    """Add active ``p``, apparent ``s`` and reactive ``q`` power to window sums."""
    n = F.col("n")
    return (
        df.withColumn("p", active_power(F.col("sum_vi"), n))
        .withColumn("s", apparent_power(F.col("sum_vv"), F.col("sum_cc"), n))
        .withColumn("q", reactive_power(F.col("s"), F.col("p")))
    )


def feature_columns(df: DataFrame, params: DetectorParams) -> list[Column]:
    scale = safe_ln if params.use_log else (lambda x: x)
    return [scale(F.col("p")).alias("f1"), scale(F.col("q")).alias("f2")]


def dense_index(windows: DataFrame, params: DetectorParams) -> DataFrame:
    """Number the non-empty windows of each stream 0, 1, 2, ... in time order."""
    block = int_div(F.col("window_no"), params.feature_block)
    return number_rows(windows, ["stream_id"], ["window_no"], block)


def _as_features(numbered: DataFrame, params: DetectorParams) -> DataFrame:
    return power_columns(numbered).select(
        "stream_id", "idx", "window_no", *feature_columns(power_columns(numbered), params),
        F.col("n").alias("size"),
    )


def features(samples: DataFrame, params: DetectorParams) -> DataFrame:
    """Features of complete input. One scan; the per-window sums are settled for numbering."""
    return _as_features(dense_index(settle(window_sums(samples, params)), params), params)


def _has(words: Column, slot: Column) -> Column:
    word = F.get(words, int_div(slot, WORD).cast("int"))
    return F.call_function("shiftright", word, (slot % WORD).cast("int")).bitwiseAND(1) == 1


def _last(items: Column, wanted) -> Column:
    """``at`` of the last item that is wanted, null if none is."""
    found = F.filter(items, wanted)
    return F.get(found, F.size(found) - 1)["at"]


def last_with_slot(entries: DataFrame, asked: DataFrame, params: DetectorParams, levels: int = 2) -> DataFrame:
    """The last entry before each asked place that has the slot: ``(stream_id, at, slot, source)``.

    ``entries`` is ``(stream_id, at, words)``, ``asked`` is ``(stream_id, at, slot)``. Entries meet in groups of
    ``carry_block``; what a group does not know is asked of the groups before it, whose bitmaps are the entries one
    level up. The top level holds one bitmap per ``carry_block ** levels`` windows of a stream.
    """
    group = int_div(F.col("at"), params.carry_block).cast("long") if levels else (F.col("at") * 0)
    grouped = entries.withColumn("grp", group)
    items = grouped.groupBy("stream_id", "grp").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("items"))
    found = asked.withColumn("grp", group).join(items, ["stream_id", "grp"], "left").select(
        "stream_id", "at", "slot", "grp",
        _last(F.col("items"), lambda x: (x["at"] < F.col("at")) & _has(x["words"], F.col("slot"))).alias("source"))
    if not levels:
        return found.drop("grp").filter("source is not null")
    found = settle(found)
    count = -(-params.w1 // WORD)
    above = grouped.groupBy("stream_id", F.col("grp").alias("at")).agg(
        F.array(*[F.bit_or(F.get("words", F.lit(k))) for k in range(count)]).alias("words"))
    open_ = found.filter("source is null").select("stream_id", F.col("grp").alias("at"), "slot").distinct()
    known = last_with_slot(above, open_, params, levels - 1)
    inside = known.select("stream_id", F.col("at").alias("asker"), "slot", F.col("source").alias("grp")).join(items, ["stream_id", "grp"])
    handed = inside.select("stream_id", F.col("asker").alias("grp"), "slot",
                           _last(F.col("items"), lambda x: _has(x["words"], F.col("slot"))).alias("source"))
    return (found.filter("source is not null").select("stream_id", "at", "slot", "source").unionByName(
        found.filter("source is null").drop("source").join(handed, ["stream_id", "grp", "slot"]).select("stream_id", "at", "slot", "source")))


def locf_sums(samples: DataFrame, params: DetectorParams) -> DataFrame:
    """Numbered window sums where short windows are filled with last-known slot values.

    The first window of a stream and every window with at least ``w1`` rows stay as they
    are. Any other window takes the last value of every slot seen so far. Bitmaps of the present slots come
    with the window sums; from them alone follows which slots a short window lacks and which window supplies each.
    Only those readings are fetched from the samples (and all of a short window that holds copies, to count each
    slot once), so what moves follows the number of missing samples.
    """
    samples = readable(samples)
    if "batch_no" not in samples.columns:
        samples = samples.withColumn("batch_no", batch_tag("i", params.w1))
    numbered = settle(dense_index(settle(window_sums(samples, params, present=True)), params))
    bits = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    short = numbered.filter((F.col("n") < params.w1) & (F.col("idx") > 0)).withColumn("copies", F.col("n") > bits)
    slots = F.sequence(F.lit(0).cast("long"), F.lit(params.w1 - 1).cast("long"))
    entries = numbered.select("stream_id", F.col("window_no").alias("at"), "words")
    asked = short.select("stream_id", F.col("window_no").alias("at"), F.explode(
        F.filter(slots, lambda x: ~_has(F.col("words"), x))).alias("slot"))
    carried = last_with_slot(entries, asked, params)
    own = short.filter("copies").select("stream_id", F.col("window_no").alias("at"), F.explode(
        F.filter(slots, lambda x: _has(F.col("words"), x))).alias("slot"), F.col("window_no").alias("source"))
    wanted = settle(carried.unionByName(own).select(
        "stream_id", F.col("source").alias("window_no"), "slot", F.col("at").alias("target")))
    few = wanted.count() <= FETCH_BROADCAST
    sources = wanted.select("stream_id", "window_no", "slot").distinct()
    readings = samples.select("stream_id", batch_tag("i", params.w1).alias("window_no"), slot_index("i", params.w1).alias("slot"),
                              F.struct("batch_no", "voltage", "current").alias("reading"))
    latest = (readings.join(F.broadcast(sources) if few else sources, ["stream_id", "window_no", "slot"], "left_semi")
              .groupBy("stream_id", "window_no", "slot").agg(F.max("reading").alias("reading")))
    added = (latest.join(wanted, ["stream_id", "window_no", "slot"])
             .select("stream_id", F.col("target").alias("window_no"), "reading.voltage", "reading.current")
             .groupBy(*KEYS).agg(*_sums()))
    base = numbered.join(short.select(*KEYS, "copies"), KEYS, "left")
    keeps = F.coalesce(~F.col("copies"), F.lit(True))
    return base.alias("own").join(added.alias("more"), KEYS, "left").select(
        *KEYS, "idx", *[(F.when(keeps, F.col(f"own.{c}")).otherwise(0) + F.coalesce(f"more.{c}", F.lit(0))).alias(c) for c in SUMS])


def locf_features(samples: DataFrame, params: DetectorParams) -> DataFrame:
    """Features of input with missing samples."""
    return _as_features(locf_sums(samples, params), params)
