"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift import job
from wattshift.functions.power import (
    batch_tag,
    euclidean,
    event_time,
    instant_power,
    int_div,
    shift_indices,
    slot_index,
)
from wattshift.operators import clustering as cl
from wattshift.operators import detect as de
from wattshift.operators import events as ev
from wattshift.operators import features as fe
from wattshift.operators import frames as fr
from wattshift.operators import reconcile as rc
from wattshift.operators.ordering import row_chunks
from wattshift.operators.udtf import detect_steps, detect_udtf
from wattshift.plans.replay import steps_of, write_replay, write_timed
from wattshift.plans.testbed import BLOCK, PARAMS, events, gappy, signal, signal_multi
from wattshift.session import scratch_path, settle
from wattshift.sources import samples as src
from wattshift.sources.results import ResultTable, result_json
from wattshift.streaming import pipeline as pl
from wattshift.streaming.audit import waiting_windows
from wattshift.streaming.handover import history_state, results_from_history
from wattshift.streaming.recheck import stream_recheck_points
from wattshift.streaming.sequence import in_sequence
from wattshift.streaming.trailing import stream_trailing
from wattshift.streaming.verify import latest_results, verified_results

WINDOW = ["stream_id", "window_id"]
# Partitions that do not end where a quiet window would restart, so provisional results err.
MISALIGNED = replace(PARAMS, partition=130)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__.removesuffix("_rows")] = f
    return f


def r6(c: str):
    return F.round(c, 6).alias(c)


def features_of(samples: DataFrame) -> DataFrame:
    return fe.features(samples, PARAMS)


def series(spark, sf) -> DataFrame:
    return features_of(signal(spark, sf))


def many_series(spark, sf) -> DataFrame:
    return features_of(signal_multi(spark, sf))


def blocks(spark, sf) -> DataFrame:
    return fr.window_points(series(spark, sf), BLOCK)


def clustered(spark, sf) -> DataFrame:
    return settle(cl.cluster_assign(blocks(spark, sf), WINDOW, PARAMS))


def text(c: str):
    return F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)


def shown_features(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "idx", "window_no", r6("f1"), r6("f2"), "size")


# --- sources and sinks ---


def _replayed(spark, samples, shuffle_within=0):
    session = pl.stateful_session(spark)
    path, files = write_replay(spark, samples, PARAMS, shuffle_within=shuffle_within)
    return session, src.stream_batches(session, path, files)


@query
def src_ordered(spark, sf):
    session, stream = _replayed(spark, signal(spark, sf))
    rows = stream.filter(~F.col("ended"))
    return pl.run_to_files(rows, spark, "src-ordered").select(
        "stream_id", "batch_no", "i", "voltage", "current"
    )


@query
def src_out_of_order(spark, sf):
    session, stream = _replayed(spark, signal(spark, sf), PARAMS.max_latency)
    rows = stream.filter(~F.col("ended")).select("stream_id", "i", "voltage", "current")
    return pl.run_to_files(rows, spark, "src-late")


@query
def decode_records(spark, sf):
    """Wire texts with numbers as text; failed readings carry an unreadable voltage."""
    e = events(spark, sf)
    record = F.struct(
        F.col("event_id").alias("i"),
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.col("value").cast("string"))
        .alias("voltage"),
        F.get_json_object("props", "$.k").cast("int").alias("current"),
    )
    texts = (
        e.groupBy(batch_tag("event_id", PARAMS.w1).alias("batch_no"))
        .agg(F.to_json(F.struct(F.sort_array(F.collect_list(record)).alias("records"))).alias("value"))
    )
    return src.decode_records(src.parse_batches(texts), on_bad="stop").select(
        "batch_no", "i", "voltage", "current"
    )


@query
def decode_quarantine(spark, sf):
    """The records of the same texts that cannot be read; every fifth text is unreadable as a whole."""
    e = events(spark, sf)
    record = F.struct(
        F.col("event_id").alias("i"),
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.col("value").cast("string"))
        .alias("voltage"),
        F.get_json_object("props", "$.k").cast("int").alias("current"),
    )
    batches = e.groupBy(batch_tag("event_id", PARAMS.w1).alias("batch_no")).agg(F.sort_array(F.collect_list(record)).alias("records"))
    whole = F.to_json(F.struct(F.lit(0).alias("stream_id"), "batch_no", "records"))
    texts = batches.select(F.when(F.col("batch_no") % 5 == 0, F.concat(F.lit('{"stream_id":0,"batch_no":'), "batch_no", F.lit(',"records":7}')))
                           .otherwise(whole).alias("value"))
    return src.quarantine(src.wire_batches(texts)).select("batch_no", "i")


@query
def null_readings(spark, sf):
    """Window sums where failed readings have no voltage: they are missing samples."""
    rows = signal(spark, sf).join(events(spark, sf).select(F.col("event_id").alias("i"), "event_type"), "i")
    failed = rows.withColumn("voltage", F.when(F.col("event_type") != "error", F.col("voltage")))
    return fe.power_columns(fe.window_sums(failed, PARAMS)).select("stream_id", "window_no", "n", r6("p"), r6("s"))


@query
def batch_tag_rows(spark, sf):
    return signal(spark, sf).select("stream_id", "i", batch_tag("i", PARAMS.w1).alias("batch_no"))


@query
def event_time_rows(spark, sf):
    return signal(spark, sf).select(
        "stream_id", "i", F.unix_millis(event_time("i")).alias("ts_ms")
    )


@query
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    signal(spark, sf).select("i", "voltage", "current").write.csv(path, header=False)
    return src.read_csv(spark, path)


@query
def row_chunks_rows(spark, sf):
    rows = events(spark, sf).select(
        (F.col("user_id") % 4).alias("stream_id"),
        F.col("event_id").alias("i"),
        F.col("value").alias("voltage"),
    )
    return row_chunks(rows, ["stream_id"], ["i", "voltage"], 1000, int_div(F.col("i"), 65536))


@query
def feature_array_scan(spark, sf):
    path = scratch_path(spark, "arrays")
    (
        cl.window_arrays(blocks(spark, sf), WINDOW)
        .select(F.to_json(F.transform("points", lambda p: F.array(p["f1"], p["f2"]))))
        .write.text(path)
    )
    rows = src.read_feature_arrays(spark, path, whole_file=False)
    return rows.select("idx", r6("f1"), r6("f2"))


@query
def result_json_rows(spark, sf):
    return result_json(de.detect_all_rows(series(spark, sf), PARAMS))


# --- projections and window metrics ---


@query
def instant_power_rows(spark, sf):
    return signal(spark, sf).select("stream_id", "i", F.round(instant_power(), 6).alias("power"))


@query
def slot_index_rows(spark, sf):
    return signal(spark, sf).select("stream_id", "i", slot_index("i", PARAMS.w1).alias("slot"))


def _powered(spark, sf):
    return fe.power_columns(fe.window_sums(signal_multi(spark, sf), PARAMS))


@query
def active_power(spark, sf):
    return _powered(spark, sf).select("stream_id", "window_no", r6("p"))


@query
def apparent_power(spark, sf):
    return _powered(spark, sf).select("stream_id", "window_no", r6("s"))


@query
def reactive_power(spark, sf):
    return _powered(spark, sf).select("stream_id", "window_no", r6("q"))


@query
def log_features(spark, sf):
    df = _powered(spark, sf)
    f1, f2 = fe.feature_columns(df, PARAMS)
    return df.select("stream_id", "window_no", F.round(f1, 6).alias("f1"), F.round(f2, 6).alias("f2"))


@query
def tumbling_features(spark, sf):
    df = _powered(spark, sf)
    f1, f2 = fe.feature_columns(df, PARAMS)
    return df.select(
        "stream_id", "window_no",
        F.round(f1, 6).alias("f1"), F.round(f2, 6).alias("f2"), F.col("n").alias("size"),
    )


@query
def window_count(spark, sf):
    return fe.locf_sums(gappy(spark, sf), PARAMS).select(
        "stream_id", "window_no", F.col("n").alias("size")
    )


@query
def dense_index(spark, sf):
    windows = settle(fe.window_sums(gappy(spark, sf), PARAMS).select("stream_id", "window_no"))
    return fe.dense_index(windows, PARAMS).select("stream_id", "window_no", "idx")


@query
def features(spark, sf):
    return shown_features(many_series(spark, sf))


@query
def locf_features(spark, sf):
    return shown_features(fe.locf_features(gappy(spark, sf), PARAMS))


@query
def partition_key(spark, sf):
    return fr.partition_key(series(spark, sf), PARAMS).select(
        "stream_id", "idx", "part_key", "part_offset"
    )


@query
def overlap_partitions(spark, sf):
    return fr.overlap_partitions(series(spark, sf), PARAMS).select(
        "stream_id", "idx", "part_key", "part_offset"
    )


@query
def overlap_suppress(spark, sf):
    parts = fr.overlap_partitions(series(spark, sf), PARAMS)
    return fr.overlap_suppress(parts, PARAMS).select("stream_id", "idx", "part_key", "part_offset")


# --- clustering and event model, by blocks of features ---


@query
def eps_neighbours(spark, sf):
    return cl.eps_neighbours(blocks(spark, sf), WINDOW, PARAMS).select(*WINDOW, "a", "b", r6("dist"))


@query
def euclid_distance(spark, sf):
    """Distance of every feature to the one before it."""
    f = series(spark, sf)
    before = f.select("stream_id", (F.col("idx") + 1).alias("idx"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    dist = euclidean(F.col("f1"), F.col("f2"), F.col("g1"), F.col("g2"))
    return f.join(before, ["stream_id", "idx"]).select(
        "stream_id", "idx", F.round(dist, 6).alias("dist")
    )


@query
def noise_points(spark, sf):
    return cl.noise_points(blocks(spark, sf), WINDOW, PARAMS).select(*WINDOW, "pos")


@query
def cluster_assign(spark, sf):
    return cl.cluster_assign(blocks(spark, sf), WINDOW, PARAMS).select(*WINDOW, "pos", "cluster_id")


@query
def cluster_stats(spark, sf):
    stats = cl.cluster_stats(cl.cluster_assign(blocks(spark, sf), WINDOW, PARAMS), WINDOW)
    return stats.select(*WINDOW, "cluster_id", "u", "v", "n", r6("loc"))


@query
def cluster_members(spark, sf):
    assigned = cl.cluster_assign(blocks(spark, sf), WINDOW, PARAMS)
    return cl.cluster_members(assigned, WINDOW).select(*WINDOW, "cluster_id", text("members"))


def _stats(spark, sf):
    return cl.cluster_stats(clustered(spark, sf), WINDOW)


@query
def dense_clusters(spark, sf):
    return cl.dense_clusters(_stats(spark, sf), PARAMS).select(*WINDOW, "cluster_id", "u", "v", "n")


@query
def cluster_guard(spark, sf):
    return cl.cluster_guard(_stats(spark, sf), WINDOW, PARAMS)


@query
def cluster_pairs(spark, sf):
    return ev.cluster_pairs(cl.dense_clusters(_stats(spark, sf), PARAMS), WINDOW)


@query
def ordered_pairs(spark, sf):
    pairs = ev.cluster_pairs(cl.dense_clusters(_stats(spark, sf), PARAMS), WINDOW)
    return ev.ordered_pairs(pairs)


@query
def event_intervals(spark, sf):
    assigned = clustered(spark, sf)
    real = cl.cluster_stats(assigned, WINDOW).filter("cluster_id <> -1")
    pairs = ev.ordered_pairs(ev.cluster_pairs(real, WINDOW))
    noise = assigned.filter("cluster_id = -1")
    return ev.event_intervals(pairs, noise, WINDOW).select(*WINDOW, "c1", "c2", text("interval"))


@query
def event_candidates(spark, sf):
    return ev.event_candidates(clustered(spark, sf), WINDOW, PARAMS).select(
        *WINDOW, "c1", "c2", text("interval")
    )


@query
def event_bounds(spark, sf):
    found = ev.event_candidates(clustered(spark, sf), WINDOW, PARAMS)
    return ev.event_bounds(found).select(*WINDOW, "c1", "c2", "first", "last")


@query
def candidate_loss(spark, sf):
    """Loss of every ordered cluster pair with the widest possible interval: all noise
    between the start of the first and the end of the second cluster."""
    assigned = clustered(spark, sf)
    real = cl.cluster_stats(assigned, WINDOW).filter("cluster_id <> -1")
    wide = ev.cluster_pairs(real, WINDOW).withColumn("v1", F.col("u1")).withColumn("u2", F.col("v2"))
    given = ev.event_intervals(wide, assigned.filter("cluster_id = -1"), WINDOW)
    return ev.candidate_loss(given, assigned, WINDOW).select(
        *WINDOW, "c1", "c2", "first", "last", "a", "b", "c", "loss"
    )


@query
def best_candidate(spark, sf):
    assigned = clustered(spark, sf)
    losses = ev.candidate_loss(ev.event_candidates(assigned, WINDOW, PARAMS), assigned, WINDOW)
    return ev.best_candidate(losses, WINDOW, PARAMS)


@query
def suffix_cuts(spark, sf):
    return ev.suffix_cuts(blocks(spark, sf), WINDOW).select(*WINDOW, "cut", "pos", r6("f1"))


@query
def backward_pass(spark, sf):
    return ev.backward_pass(blocks(spark, sf), WINDOW, PARAMS)


@query
def detect_window(spark, sf):
    return ev.detect_window(blocks(spark, sf), WINDOW, PARAMS)


@query
def shift_indices_rows(spark, sf):
    """Member positions of each cluster turned into indices of the whole series."""
    members = cl.cluster_members(clustered(spark, sf), WINDOW)
    return members.select(
        *WINDOW, "cluster_id",
        F.concat_ws(
            ",", shift_indices(F.col("members"), F.col("window_id") * BLOCK).cast("array<string>")
        ).alias("indices"),
    )


# --- frames ---


@query
def prefix_counts(spark, sf):
    return fr.prefix_counts(blocks(spark, sf), WINDOW).select(
        *WINDOW, "pos", "n", r6("low"), r6("high")
    )


@query
def trailing_buffer(spark, sf):
    return fr.trailing_buffer(series(spark, sf), PARAMS)


# --- detection over whole series ---


@query
def detect_events(spark, sf):
    return de.detect_events(series(spark, sf), PARAMS)


@query
def detect_all_rows_rows(spark, sf):
    return de.detect_all_rows(series(spark, sf), PARAMS)


@query
def detect_partitioned(spark, sf):
    """Four series, each cut into chunks that are judged in parallel."""
    return de.detect_all_rows(many_series(spark, sf), PARAMS)


@query
def detect_first(spark, sf):
    return de.first_event(many_series(spark, sf), PARAMS)


@query
def detect_udtf_rows(spark, sf):
    return detect_udtf(series(spark, sf), PARAMS)


@query
def detect_steps_rows(spark, sf):
    """Four series through the table function that reads a series in order."""
    return detect_steps(many_series(spark, sf), PARAMS)


@query
def window_resets(spark, sf):
    return de.window_moves(series(spark, sf), PARAMS).select(
        "stream_id", "idx", "new_start", F.col("event_end").isNotNull().alias("by_event")
    )


@query
def sorted_results(spark, sf):
    return de.sorted_results(de.detect_all_rows(many_series(spark, sf), PARAMS))


# --- results ---


@query
def provisional_results(spark, sf):
    return rc.provisional_results(series(spark, sf), PARAMS)


@query
def reconcile_merge(spark, sf):
    f = series(spark, sf)
    return rc.reconcile_merge(rc.provisional_results(f, MISALIGNED), de.detect_events(f, PARAMS))


@query
def pending_minus_verified(spark, sf):
    """Provisional results not yet answered by a verified event."""
    f = series(spark, sf)
    pending = rc.provisional_results(f, PARAMS).select("stream_id", "s", "event_s")
    return rc.pending_minus_verified(pending, de.detect_events(f, PARAMS))


@query
def range_lookup(spark, sf):
    """Features inside each event's interval."""
    f = series(spark, sf)
    regions = de.detect_events(f, PARAMS).select(
        "stream_id", F.col("s").alias("region_id"),
        F.col("event_start").alias("a"), (F.col("event_end") + 1).alias("b"),
    )
    return rc.range_lookup(f, regions).select("stream_id", "region_id", "idx", r6("f1"), r6("f2"))


@query
def recheck_points(spark, sf):
    f = series(spark, sf)
    return rc.recheck_points(f, de.detect_events(f, PARAMS), PARAMS).select(
        "stream_id", "idx", "window_no"
    )


@query
def latest_recheck(spark, sf):
    return rc.latest_recheck(de.detect_events(many_series(spark, sf), PARAMS), PARAMS)


@query
def release_below_bound(spark, sf):
    """Results final once the last event's window start is known."""
    f = many_series(spark, sf)
    found = settle(de.detect_events(f, PARAMS))
    bounds = found.groupBy("stream_id").agg(F.max("event_end").alias("bound"))
    return rc.release_below_bound(de.every_result(f, found), bounds)


@query
def contiguous_prefix(spark, sf):
    """Windows released in sequence until the first hole."""
    full = fe.window_sums(gappy(spark, sf), PARAMS).filter(F.col("n") * 10 > PARAMS.w1 * 6)
    return rc.contiguous_prefix(full.select("stream_id", F.col("window_no").alias("s"), "n"))


# --- streaming ---


@query
def stream_tumbling(spark, sf):
    session, stream = _replayed(spark, signal(spark, sf))
    rows = pl.run_to_files(pl.tumbling(stream, PARAMS), spark, "tumbling")
    return rows.select("stream_id", "window_no", r6("f1"), r6("f2"), "size")


@query
def stream_out_of_order(spark, sf):
    session, stream = _replayed(spark, signal(spark, sf), PARAMS.max_latency)
    rows = pl.run_to_files(
        pl.tumbling(stream, PARAMS, PARAMS.max_latency + 1), spark, "out-of-order"
    )
    return rows.select("stream_id", "window_no", r6("f1"), r6("f2"), "size")


@query
def stream_locf(spark, sf):
    session, stream = _replayed(spark, gappy(spark, sf), PARAMS.max_latency)
    rows = pl.run_to_files(
        pl.signal_features(stream, PARAMS, PARAMS.max_latency + 1), spark, "locf"
    )
    return shown_features(rows)


@query
def stream_sort(spark, sf):
    session, stream = _replayed(spark, signal(spark, sf), PARAMS.max_latency)
    return pl.run_to_files(
        pl.sort_by_event_time(stream, PARAMS, PARAMS.max_latency + 1), spark, "sort"
    )


@query
def stream_detect(spark, sf):
    session, stream = _replayed(spark, signal_multi(spark, sf))
    return pl.run_to_files(pl.signal_results(stream, PARAMS, fill=False), spark, "detect")


@query
def stream_end_mark(spark, sf):
    """Four streams of different lengths; the end mark on the wire releases the last windows of each."""
    session, stream = _replayed(spark, signal_multi(spark, sf))
    rows = pl.run_to_files(pl.signal_features(stream, PARAMS, fill=False), spark, "end-mark")
    return shown_features(rows)


@query
def stream_unequal_clocks(spark, sf):
    """Two streams, one a thousand windows ahead of the other all the time; neither loses or closes anything of the other."""
    ahead = signal(spark, sf).withColumn("stream_id", F.col("i") % 2).withColumn("i", F.col("i") + F.col("stream_id") * 1000 * PARAMS.w1)
    moved = ahead.withColumn("batch_no", batch_tag("i", PARAMS.w1))
    # Both streams arrive together: files follow the position in the stream, not the batch number.
    part = int_div(F.col("i") - F.col("stream_id") * 1000 * PARAMS.w1, PARAMS.w1)
    steps = settle(moved.withColumn("_at", part))
    bounds = steps.agg(F.max("_at"), F.count(F.lit(1))).first()
    files = steps_of(bounds[1])
    step = int_div(F.col("batch_no") - F.col("stream_id") * 1000, (bounds[0] or 0) // files + 1).cast("int").alias("step")
    texts = src.to_batches(steps.filter("_at >= 0"), [step]).unionByName(src.end_marks(moved, [F.lit(files).alias("step")]))
    session, path = pl.stateful_session(spark), write_timed(spark, texts, [], "unequal")
    rows = pl.run_to_files(pl.tumbling(src.stream_batches(session, path), PARAMS), spark, "clocks")
    return rows.select("stream_id", "window_no", r6("f1"), r6("f2"), "size")


@query
def stream_idle_close(spark, sf):
    """Four streams; two of them stop in the middle of the replay without an end mark, and a timer closes their last windows."""
    rows = signal_multi(spark, sf)
    last = rows.groupBy("stream_id").agg(F.max("batch_no").alias("last"))
    stops = F.col("stream_id") % 2 == 1
    step = int_div(F.col("batch_no") * F.when(stops, 2).otherwise(6), F.col("last") + 1).cast("int").alias("step")
    steps = src.to_batches(rows, ["stream_id", "batch_no"]).join(F.broadcast(last), "stream_id").select("stream_id", step, "value")
    ends = src.end_marks(rows, ["stream_id"]).filter(~stops).select("stream_id", F.lit(6).alias("step"), "value")
    path = write_timed(spark, steps.unionByName(ends), ["stream_id"], "idle")
    stream = src.stream_batches(pl.stateful_session(spark), path, 4, arrival=True)
    closed = pl.run_to_files(pl.tumbling(stream, PARAMS, idle=pl.Idle(90_000)), spark, "idle")
    return closed.select("stream_id", "window_no", r6("f1"), r6("f2"), "size")


@query
def late_rows_rows(spark, sf):
    """Samples that lag up to two files of the replay: all come out, those of closed windows marked as late."""
    rows = signal(spark, sf)
    width = max(10, (rows.agg(F.max("batch_no")).first()[0] or 0) // 6)      # windows that arrive with one file
    rows = rows.withColumn("batch_no", F.col("batch_no") + (F.col("i") * 7919) % (2 * width))
    steps = src.to_batches(rows, ["stream_id", "batch_no"]).withColumn("step", int_div(F.col("batch_no"), width).cast("int"))
    ends = src.end_marks(rows, ["stream_id", "batch_no"]).withColumn("step", (int_div(F.col("batch_no"), width) + 1).cast("int"))
    path = write_timed(spark, steps.unionByName(ends).select("stream_id", "step", "value"), ["stream_id"], "late")
    stream = src.stream_batches(pl.stateful_session(spark), path)
    out = scratch_path(spark, "late-out")
    marked = pl.sort_by_event_time(stream, PARAMS, PARAMS.max_latency + 1, late=True)
    pl.run_available(pl.write_late_apart(marked, f"{out}/used", f"{out}/late", f"{out}/checkpoint"))
    read = lambda kind: spark.read.parquet(f"{out}/{kind}").drop("batch").withColumn("late", F.lit(kind == "late"))
    return read("used").unionByName(read("late"))


@query
def stream_from_history(spark, sf):
    """Two thirds of four streams in batch, the rest live; the last windows of history arrive again and are late."""
    rows = signal_multi(spark, sf)
    last = rows.groupBy("stream_id").agg((int_div(F.max("batch_no") * 2, 3)).alias("cut"))
    cut = rows.join(F.broadcast(last), "stream_id")
    past = settle(features_of(cut.filter("batch_no <= cut").drop("cut")))
    session, stream = _replayed(spark, cut.filter("batch_no > cut - 3").drop("cut"))
    live = pl.run_to_files(results_from_history(stream, history_state(past, PARAMS), PARAMS), spark, "live")
    return de.detect_all_rows(past, PARAMS).unionByName(live)


def _verified(spark, sf):
    session, stream = _replayed(spark, signal(spark, sf))
    return verified_results(pl.closed_windows(stream, MISALIGNED, marks=True), MISALIGNED)


@query
def stream_verify(spark, sf):
    """Live detection in chunks that do not end where windows restart; corrected results replace provisional ones."""
    return latest_results(pl.run_to_files(_verified(spark, sf), spark, "verify"))


@query
def stream_upsert(spark, sf):
    """Provisional results and corrections as they come, upserted by stream and number."""
    path = scratch_path(spark, "upsert")
    table = ResultTable(spark, f"{path}/table")
    pl.run_available(table.writer(_verified(spark, sf), f"{path}/checkpoint"))
    table.compact()
    return table.view()


@query
def stream_contiguous(spark, sf):
    """Full windows that arrive out of order are released in sequence until the first hole."""
    full = fe.window_sums(gappy(spark, sf), PARAMS).filter(F.col("n") * 10 > PARAMS.w1 * 6)
    rows = full.select("stream_id", F.col("window_no").alias("s"), "n")
    # Every row is held back by a hashed number of steps.
    last = rows.agg(F.max("s")).first()[0] or 0
    step = int_div(F.col("s") * 6, last + 1) + F.pmod(F.xxhash64("stream_id", "s"), F.lit(3))
    path = write_timed(spark, rows.select(step.cast("int").alias("step"), F.to_json(F.struct("stream_id", "s", "n")).alias("value")), [], "sequence")
    session = pl.stateful_session(spark)
    schema = "stream_id long, s long, n long"
    arriving = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    return pl.run_to_files(in_sequence(arriving, schema), spark, "sequence")


@query
def stream_recheck(spark, sf):
    """Features and results of a live stream, joined as streams."""
    session, stream = _replayed(spark, signal(spark, sf))
    sides = []
    for label, rows in (("features", pl.signal_features(stream, PARAMS, fill=False)), ("events", pl.signal_results(stream, PARAMS, fill=False))):
        path = scratch_path(spark, label)
        pl.run_available(rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state"))
        sides.append(session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows"))
    return pl.run_to_files(stream_recheck_points(*sides, PARAMS), spark, "recheck").select("stream_id", "idx", "window_no")


@query
def stream_trailing_rows(spark, sf):
    """The buffer of last features in the state of four live streams."""
    session, stream = _replayed(spark, signal_multi(spark, sf))
    rows = pl.run_to_files(stream_trailing(pl.signal_features(stream, PARAMS, fill=False), PARAMS), spark, "trailing")
    return rows.select("stream_id", "idx", "buffered", "first_idx", r6("low"), r6("high"))


@query
def state_audit(spark, sf):
    """What waits in the state of a live query over four streams whose samples lag and which have not ended."""
    rows = signal_multi(spark, sf).withColumn("batch_no", F.col("batch_no") + (F.col("i") * 7919) % (PARAMS.max_latency + 1))
    session, stream = _replayed(spark, rows)
    path = scratch_path(spark, "audit")
    open_ = pl.closed_windows(stream.filter("not ended"), PARAMS, PARAMS.max_latency + 1)
    pl.run_available(open_.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state"))
    return waiting_windows(session, f"{path}/state")


def _end_to_end(spark, samples, late):
    """Wire files in, one JSON result per feature out."""
    source, files = write_replay(spark, samples, PARAMS, shuffle_within=PARAMS.max_latency if late else 0)
    target = scratch_path(spark, "results")
    job.run(spark, source, target, late, PARAMS, files_per_trigger=files)
    return result_json(job.results(spark, target))


@query
def e2e_ordered(spark, sf):
    return _end_to_end(spark, signal(spark, sf), late=False)


@query
def e2e_out_of_order(spark, sf):
    return _end_to_end(spark, gappy(spark, sf), late=True)
