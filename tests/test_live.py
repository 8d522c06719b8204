"""Timers, verification, sequence, re-check and upsert of live streams, each with a restart where it holds state."""

import json
import os
import random
import time
from collections import deque
from dataclasses import replace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_streaming import SCHEMA, P, rows_of, samples

from wattshift.operators import detect as de
from wattshift.operators import features as fe
from wattshift.operators import reconcile as rc
from wattshift.plans.replay import write_replay
from wattshift.sources import samples as src
from wattshift.sources.results import ResultTable
from wattshift.streaming import pipeline as pl
from wattshift.streaming.audit import state_of, state_variables, waiting_windows
from wattshift.streaming.handover import history_state, results_from_history
from wattshift.streaming.recheck import stream_recheck_points
from wattshift.streaming.sequence import in_sequence
from wattshift.streaming.trailing import stream_trailing
from wattshift.streaming.verify import MapComposer, latest_results, verified_results

MINUTE = 60


def send(spark, path, name, rows, at, ended=()):
    """One wire file that arrives at a given time (seconds)."""
    os.makedirs(path, exist_ok=True)
    texts = [r["value"] for r in src.to_batches(spark.createDataFrame(rows, SCHEMA)).collect()] if rows else []
    texts += [json.dumps({"stream_id": s, "batch_no": 9999, "records": ""}) for s in ended]
    with open(f"{path}/{name}", "w") as f:
        f.write("\n".join(texts) + "\n")
    os.utime(f"{path}/{name}", (1_600_000_000 + at, 1_600_000_000 + at))


def window(stream, w):
    return [(stream, w, w * P.w1 + k, 1.0 + k, 2.0) for k in range(P.w1)]


def run(result, out, trigger=None):
    writer = result.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        query.awaitTermination()
    return query


def closed(spark, out):
    return sorted((r["stream_id"], r["window_no"]) for r in spark.read.schema("stream_id long, window_no long").parquet(f"{out}/rows").collect())


@pytest.mark.parametrize("form", ["sums", "filled"])
def test_idle_streams_close_by_timer_across_a_restart(spark, tmp_path, form):
    wire, session = str(tmp_path / "wire"), pl.stateful_session(spark, 4)

    def start(out, idle):
        stream = src.stream_batches(session, wire, arrival=True)
        if form == "sums":
            run(pl.tumbling(stream, P, idle=idle), out)
        else:
            shares = pl.closed_windows(stream, P, fill=True, groups=2, idle=idle)
            run(shares.filter("n > 0").select("stream_id", F.col("first_window").alias("window_no"), "n"), out)

    with_timer, without = str(tmp_path / "a"), str(tmp_path / "b")
    send(spark, wire, "0", window(0, 0) + window(1, 0) + window(0, 1) + window(1, 1), 0)
    for out, idle in ((with_timer, pl.Idle(3 * MINUTE * 1000)), (without, None)):
        start(out, idle)
        assert set(closed(spark, out)) == {(0, 0), (1, 0)}
    # Stream 1 stays away; its timer waits in the state over restarts until the arrivals of stream 0 have passed it.
    for step, at in ((2, 1), (3, 2)):
        send(spark, wire, str(step), window(0, step), at * MINUTE)
    start(with_timer, pl.Idle(3 * MINUTE * 1000))
    assert (1, 1) not in closed(spark, with_timer)
    for step, at in ((4, 4), (5, 5)):
        send(spark, wire, str(step), window(0, step), at * MINUTE)
    for out, idle in ((with_timer, pl.Idle(3 * MINUTE * 1000)), (without, None)):
        start(out, idle)
    assert (1, 1) in closed(spark, with_timer) and (1, 1) not in closed(spark, without)
    # It comes back: a row of the closed window is late, the next window is not.
    send(spark, wire, "6", window(1, 1) + window(1, 2) + window(0, 6), 6 * MINUTE, ended=[0, 1])
    for out, idle in ((with_timer, pl.Idle(3 * MINUTE * 1000)), (without, None)):
        start(out, idle)
        assert set(closed(spark, out)) == {(0, w) for w in range(7)} | {(1, w) for w in range(3)}
    sizes = {(r["stream_id"], r["window_no"], r["n" if form == "filled" else "size"]) for r in spark.read.parquet(f"{with_timer}/rows").collect()}
    assert {s for a, b, s in sizes if (a, b) == (1, 1)} == {P.w1 // (2 if form == "filled" else 1)}


def test_idle_by_the_clock_of_the_machine(spark, tmp_path):
    """No input at all moves time on."""
    wire, out = str(tmp_path / "wire"), str(tmp_path / "out")
    send(spark, wire, "0", window(0, 0) + window(0, 1), 0)
    stream = src.stream_batches(pl.stateful_session(spark, 2), wire)
    query = run(pl.tumbling(stream, P, idle=pl.Idle(1500, wall_clock=True)), out, {"processingTime": "500 milliseconds"})
    try:
        until = time.time() + 60
        while time.time() < until and not (os.path.exists(f"{out}/rows/_spark_metadata") and len(closed(spark, out)) == 2):
            time.sleep(1)
    finally:
        query.stop()
    assert closed(spark, out) == [(0, 0), (0, 1)]


MISFIT = replace(P, partition=15)


def test_verified_results_equal_the_sequential_ones(spark, tmp_path):
    """Two streams over a restart in the middle; chunks do not end where windows restart, so some provisional rows err."""
    given, wire, out = samples(spark, windows=110), str(tmp_path / "wire"), str(tmp_path / "out")
    session = pl.stateful_session(spark, 4)
    for step, (low, high) in enumerate(((0, 37), (37, 80), (80, 110))):
        part = given.filter(f"batch_no >= {low} and batch_no < {high}").collect()
        send(spark, wire, str(step), [tuple(r) for r in part], step, ended=[0, 1] if step == 2 else [])
        run(verified_results(pl.closed_windows(src.stream_batches(session, wire), MISFIT, marks=True), MISFIT), out)
    rows = spark.read.parquet(f"{out}/rows")
    want = de.detect_all_rows(fe.features(given, MISFIT), MISFIT)
    last = latest_results(rows)
    assert rows_of(last.select(want.columns).na.fill(-9)) == rows_of(want.na.fill(-9))
    assert rows.filter("version = 0").count() == want.count() and 0 < last.filter("corrected").count() < want.count() / 2
    # A retraction shows no event, and comes only where the provisional row showed one.
    wrong = rows.filter("version = 1 and not d").join(rows.filter("version = 0 and d"), ["stream_id", "s"], "left_anti")
    assert not wrong.count()


def test_late_filled_input_is_verified_too(spark):
    given = samples(spark, loss=0.3, windows=50)
    path, files = write_replay(spark, given, P, shuffle_within=P.max_latency)
    stream = src.stream_batches(pl.stateful_session(spark, 4), path, files)
    rows = pl.run_to_files(verified_results(pl.closed_windows(stream, MISFIT, P.max_latency + 1, fill=True), MISFIT), spark, "t")
    want = de.detect_all_rows(fe.locf_features(given, MISFIT), MISFIT)
    assert rows_of(latest_results(rows).select(want.columns).na.fill(-9)) == rows_of(want.na.fill(-9))


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop


def test_maps_that_come_early_wait():
    import pandas as pd

    composer = MapComposer(replace(P, w2=1))
    composer.at, composer.early = Value(), Map()

    def feed(chunks):
        rows = [{"stream_id": 0, "chunk": c, "low": None, "high": None, "t": [10 * c], "first": [1], "last": [2], "mask": [2], "exits": [1, 1]} for c in chunks]
        return [(r.t, r.first) for out in composer.handleInputRows((0,), iter([pd.DataFrame(rows)]), None) for r in out.itertuples()]

    assert feed([2, 3]) == [] and set(composer.early) == {(2,), (3,)}
    assert feed([0]) == []                                 # the first chunk starts at 0, whose events were shown
    assert feed([1]) == [([10], [1]), ([20], [1]), ([30], [1])] and not composer.early
    assert composer.at.get() == (4, 1)


def test_sequence_over_gaps_and_a_restart(spark, tmp_path):
    rng = random.Random(5)
    wire, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(wire)
    schema = "stream_id long, s long, d boolean, note string"
    rows = [{"stream_id": k, "s": s, "d": s % 3 == 0, "note": None if s % 5 else f"n{s}"} for k in (0, 1) for s in range(60) if (k, s) != (1, 41)]
    rows += [{"stream_id": 0, "s": None, "d": True, "note": "x"}, {"stream_id": None, "s": 0, "d": True, "note": "x"}]
    rng.shuffle(rows)
    rows.insert(len(rows) // 2, rows[0])                   # the same row again
    session, want = pl.stateful_session(spark, 2), {}
    for step in range(4):
        part = rows[step * len(rows) // 4: (step + 1) * len(rows) // 4]
        with open(f"{wire}/{step}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in part) + "\n")
        stream = session.readStream.schema(schema).json(wire)
        run(in_sequence(stream, schema), out)
        seen = {(r["stream_id"], r["s"]) for r in rows[: (step + 1) * len(rows) // 4]}
        for k in (0, 1):
            want[k] = next(s for s in range(61) if (k, s) not in seen)
        got = spark.read.schema(schema).parquet(f"{out}/rows").collect()
        assert sorted((r["stream_id"], r["s"]) for r in got) == [(k, s) for k in (0, 1) for s in range(want[k])]
    assert want == {0: 60, 1: 41}
    by_key = {(r["stream_id"], r["s"]): (r["d"], r["note"]) for r in rows}
    assert all(by_key[r["stream_id"], r["s"]] == (r["d"], r["note"]) for r in got)


def test_recheck_as_a_join_of_streams(spark, tmp_path):
    given = samples(spark, windows=120)
    features = fe.features(given, P).withColumn("step", F.expr("idx div 20"))
    results = de.detect_all_rows(fe.features(given, P), P).withColumn("step", F.expr("s div 20"))
    sides = {"features": features, "results": results}
    for step in range(6):
        for name, rows in sides.items():
            rows.filter(f"step = {step}").drop("step").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(0.05)
    session, out = pl.stateful_session(spark, 2), str(tmp_path / "out")
    streams = [session.readStream.schema(sides[n].drop("step").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in sides]
    query = run(stream_recheck_points(*streams, P, lag=30), out)
    want = rc.recheck_points(features.drop("step"), de.detect_events(features.drop("step"), P), P)
    assert want.count() > 3 and rows_of(spark.read.parquet(f"{out}/rows").select(want.columns)) == rows_of(want)
    # The join's state is bounded by the interval and the lag, not by the length of the streams.
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 2 * 2 * (2 * (P.w2 + 1) + 2 * 30 + 20)


def test_upsert_survives_a_killed_batch(spark, tmp_path):
    given, wire, out = samples(spark, windows=110), str(tmp_path / "wire"), str(tmp_path / "out")
    session = pl.stateful_session(spark, 4)
    for step, (low, high) in enumerate(((0, 37), (37, 80), (80, 110))):
        part = given.filter(f"batch_no >= {low} and batch_no < {high}").collect()
        send(spark, wire, str(step), [tuple(r) for r in part], step, ended=[0, 1] if step == 2 else [])
    table, failed = ResultTable(spark, f"{out}/table"), []
    written = table.write_batch

    def dies_once(rows, batch):
        written(rows, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("killed behind the write")

    table.write_batch = dies_once

    def start():
        stream = src.stream_batches(session, wire)
        pl.run_available(table.writer(verified_results(pl.closed_windows(stream, MISFIT, marks=True), MISFIT), f"{out}/state"))

    with pytest.raises(StreamingQueryException):
        start()
    start()
    want = rows_of(de.detect_all_rows(fe.features(given, MISFIT), MISFIT).na.fill(-9))
    columns = ["stream_id", "s", "d", "event_s", "event_start", "event_end"]
    assert failed and rows_of(table.view().select(columns).na.fill(-9)) == want
    table.compact()
    written(table.view().limit(3).withColumn("d", F.lit(True)).withColumn("version", F.lit(9)), 1)   # a batch that has been taken in
    assert rows_of(table.view().select(columns).na.fill(-9)) == want
    bounds = spark.createDataFrame([(0, 30), (1, 0)], "stream_id long, bound long")
    assert rc.release_below_bound(table.view(), bounds).count() == 30


def test_last_writer_wins(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "t"))
    schema = "stream_id long, s long, d boolean, version int"
    table.write_batch(spark.createDataFrame([(0, 1, True, 0), (0, 2, True, 0), (0, 2, False, 1)], schema), 0)
    table.write_batch(spark.createDataFrame([(0, 1, False, 0)], schema), 2)
    table.write_batch(spark.createDataFrame([(0, 3, True, 0)], schema), 10)
    want = [(0, 1, False), (0, 2, False), (0, 3, True)]
    assert sorted(map(tuple, table.view().collect())) == want
    table.compact()
    table.write_batch(spark.createDataFrame([(0, 2, True, 0)], schema), 11)
    assert sorted(map(tuple, table.view().collect())) == [(0, 1, False), (0, 2, True), (0, 3, True)]
    os.makedirs(str(tmp_path / "t" / "batch-12"))          # a batch that was never finished does not count
    assert table.view().count() == 3


def test_late_rows_come_apart_and_are_counted(spark, tmp_path):
    wire, out = str(tmp_path / "wire"), str(tmp_path / "out")
    send(spark, wire, "0", window(0, 0) + window(0, 5), 0)
    send(spark, wire, "1", window(0, 6), 1)
    send(spark, wire, "2", window(0, 2) + window(0, 6), 2)        # window 2 was closed by window 5, window 6 is open
    send(spark, wire, "3", window(0, 5)[:3], 3, ended=[0])        # window 5 was closed by window 6
    stream = src.stream_batches(pl.stateful_session(spark, 2), wire)
    writer = pl.write_late_apart(pl.sort_by_event_time(stream, P, 1, late=True), f"{out}/used", f"{out}/late", f"{out}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    per = lambda kind: sorted((r["i"] // P.w1) for r in spark.read.parquet(f"{out}/{kind}").collect())
    assert per("late") == [2] * P.w1 + [5] * 3 and per("used") == [0] * P.w1 + [5] * P.w1 + [6] * 2 * P.w1
    seen = [p["observedMetrics"]["lateness"] for p in query.recentProgress if "lateness" in p["observedMetrics"]]
    assert sum(m["late"] for m in seen) == P.w1 + 3 and sum(m["used"] for m in seen) == 4 * P.w1


def test_live_results_go_on_from_history(spark, tmp_path):
    """History in batch, then live over a restart; a stream that is new begins at 0; a short history is enough."""
    given, out, wire = samples(spark, windows=90), str(tmp_path / "out"), str(tmp_path / "wire")
    cuts = {0: 55, 1: 4}
    past = given.filter(" or ".join(f"(stream_id = {k} and batch_no <= {c})" for k, c in cuts.items()))
    fresh = given.filter("stream_id = 0").withColumn("stream_id", F.lit(7).cast("long"))
    history = history_state(fe.features(past, P), P)
    rest = given.filter(" or ".join(f"(stream_id = {k} and batch_no > {c - 2})" for k, c in cuts.items())).unionByName(fresh).collect()
    session = pl.stateful_session(spark, 4)
    for step, (low, high) in enumerate(((0, 60), (60, 90))):
        send(spark, wire, str(step), [tuple(r) for r in rest if low <= r["batch_no"] < high], step, ended=[0, 1, 7] if step else [])
        run(results_from_history(src.stream_batches(session, wire), history, P), out)
    want = de.detect_all_rows(fe.features(given.unionByName(fresh), P), P)
    live = spark.read.parquet(f"{out}/rows")
    assert {k: live.filter(f"stream_id = {k}").agg(F.min("s")).first()[0] for k in (0, 1, 7)} == {0: 56, 1: 5, 7: 0}
    whole = de.detect_all_rows(fe.features(past, P), P).unionByName(live)
    assert rows_of(whole.select(want.columns).na.fill(-9)) == rows_of(want.na.fill(-9))


def test_debug_prints_what_was_written(spark, tmp_path):
    """The print reads the written results, each file once over two calls, and not the wire again."""
    from wattshift import job

    given, wire, target = samples(spark, windows=12).filter("stream_id = 0"), str(tmp_path / "wire"), str(tmp_path / "out")
    for step, (low, high) in enumerate(((0, 8), (8, 12))):
        part = [tuple(r) for r in given.filter(f"batch_no >= {low} and batch_no < {high}").collect()]
        send(spark, wire, str(step), part, step, ended=[0] if step else [])
        job.run(spark, wire, target, params=P, debug=True)
    sources = os.path.join(target, "state", "debug", "sources", "0")
    lines = [json.loads(x) for f in os.listdir(sources) if not f.startswith(".") for x in open(os.path.join(sources, f)) if x.startswith("{")]
    written = {f for f in os.listdir(os.path.join(target, "results")) if f.endswith(".json")}
    assert sorted(os.path.basename(x["path"]) for x in lines) == sorted(written) and all("/out/results/" in x["path"] for x in lines)
    assert job.results(spark, target).count() == 12


def feature_files(spark, path, files):
    """One JSON file of features per entry, in the order of arrival."""
    os.makedirs(path, exist_ok=True)
    for name, rows in files:
        with open(f"{path}/{name}", "w") as f:
            f.writelines(json.dumps({"stream_id": s, "idx": i, "f1": x, "f2": -x}) + "\n" for s, i, x in rows)
        os.utime(f"{path}/{name}", (1_600_000_000 + int(name), 1_600_000_000 + int(name)))


def test_trailing_buffer_in_state_stays_flat_over_restarts(spark, tmp_path):
    """10,000 features of one stream and a few of another, in four runs: like a plain deque, and old blocks leave the state."""
    small, keep = replace(P, w2=5), 12
    length, rng = keep * small.w2 + 2, random.Random(4)
    values = {0: [rng.random() for _ in range(10_000)], 1: [rng.random() for _ in range(30)]}
    session, wire, out = pl.stateful_session(spark, 2), str(tmp_path / "wire"), str(tmp_path / "out")
    sizes, at = [], 0
    for step in range(4):
        rows = [(0, i, values[0][i]) for i in range(at, at + 2500)] + [(1, i, values[1][i]) for i in range(step * 7, step * 7 + 7)]
        at += 2500
        feature_files(spark, wire, [(str(2 * step), rows[:900]), (str(2 * step + 1), rows[900:])])
        stream = session.readStream.schema("stream_id long, idx long, f1 double, f2 double").option("maxFilesPerTrigger", 1).json(wire)
        run(stream_trailing(stream, small, keep), out)
        blocks = state_of(session, f"{out}/state", "blocks").select("key.stream_id", F.length("user_map_value.features").alias("n"))
        sizes.append({r["stream_id"]: r["n"] // 16 for r in blocks.groupBy("stream_id").agg(F.sum("n").alias("n")).collect()})
    assert all(s[0] < 2 * length for s in sizes) and [s[1] for s in sizes] == [7, 14, 21, 28]
    got = sorted(spark.read.parquet(f"{out}/rows").collect(), key=lambda r: (r["stream_id"], r["idx"]))
    want = []
    for s, n in ((0, 10_000), (1, 28)):
        buffer = deque(maxlen=length)
        for i in range(n):
            buffer.append(values[s][i])
            want.append((s, i, len(buffer), i - len(buffer) + 1, min(buffer), max(buffer)))
    assert [tuple(r) for r in got] == want


def test_a_gap_in_features_stops_the_trailing_buffer(spark, tmp_path):
    feature_files(spark, str(tmp_path / "wire"), [("0", [(0, 0, 1.0), (0, 2, 1.0)])])
    stream = pl.stateful_session(spark, 1).readStream.schema("stream_id long, idx long, f1 double, f2 double").json(str(tmp_path / "wire"))
    with pytest.raises(StreamingQueryException, match="1 is next|0 is next"):
        run(stream_trailing(stream, P), str(tmp_path / "out"))


def test_audit_of_waiting_windows(spark, tmp_path):
    """The audit follows the state batch by batch, for one key a stream and for slot groups."""
    session, wire = pl.stateful_session(spark, 2), str(tmp_path / "wire")
    send(spark, wire, "0", window(0, 0) + window(0, 1) + window(1, 0), 0)
    send(spark, wire, "1", window(0, 2) + window(0, 3), 1)
    for form, groups in (("sums", 1), ("filled", 2)):
        out = str(tmp_path / form)
        run(pl.closed_windows(src.stream_batches(session, wire), P, 3, fill=form == "filled", groups=groups), out)
        audit = lambda batch=None, out=out: sorted(tuple(r) for r in waiting_windows(session, f"{out}/state", batch=batch).collect())
        assert audit() == [(0, 0, 3, 1, 3), (1, -3, 1, 0, 0)]
        assert audit(0) == [(0, -2, 2, 0, 1), (1, -3, 1, 0, 0)]
        held = state_variables(session, f"{out}/state").first()
        assert (held["operator_id"], held["partitions"], held["newest"]) == (0, 2, 1)
    send(spark, wire, "2", [], 2, ended=[0, 1])
    run(pl.closed_windows(src.stream_batches(session, wire), P, 3), str(tmp_path / "sums"))
    assert [r["waiting"] for r in waiting_windows(session, str(tmp_path / "sums/state")).collect()] == [0, 0]
