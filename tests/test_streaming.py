import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wattshift.config import DetectorParams
from wattshift.operators import detect as de
from wattshift.operators import features as fe
from wattshift.plans.replay import write_replay
from wattshift.sources import samples as src
from wattshift.streaming import pipeline as pl

P = DetectorParams(w1=8, w2=10, partition=22, eps=0.6, max_latency=3)
SCHEMA = "stream_id long, batch_no long, i long, voltage double, current double"


def samples(spark, loss=0.0, windows=60):
    rng = random.Random(11)
    rows = []
    for stream in (0, 1):
        level = 1.0
        for i in range(windows * P.w1):
            if i % (6 * P.w1 + 3) == 0:
                level = rng.choice([1.0, 30.0, 900.0])
            if rng.random() >= loss:
                rows.append((stream, i // P.w1, i, level * rng.uniform(1, 1.4), rng.uniform(1, 1.3)))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, digits=9):
    return sorted(
        tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()
    )


def test_ordered_stream_equals_batch(spark):
    given = samples(spark)
    session = pl.stateful_session(spark)
    path, files = write_replay(spark, given, P)
    stream = src.stream_batches(session, path, files)
    got = pl.run_to_files(pl.signal_results(stream, P), spark, "t")
    want = de.detect_all_rows(fe.features(given, P), P)
    assert want.filter("d").count() > 3
    assert rows_of(got.select(want.columns).na.fill(-9)) == rows_of(want.na.fill(-9))


def test_late_and_missing_samples_equal_batch(spark):
    given = samples(spark, loss=0.3)
    session = pl.stateful_session(spark)
    path, files = write_replay(spark, given, P, shuffle_within=P.max_latency)
    stream = src.stream_batches(session, path, files)
    got = pl.run_to_files(pl.signal_features(stream, P, P.max_latency + 1), spark, "t")
    want = fe.locf_features(given, P)
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_too_late_samples_are_dropped(spark, tmp_path):
    path = str(tmp_path / "wire")
    for step, sent in enumerate([[0, 1, 9], [17, 25], [33, 41], [2, 49]]):
        rows = [(0, max(i // P.w1 for i in sent), i, 1.0, 2.0) for i in sent]
        src.to_batches(spark.createDataFrame(rows, SCHEMA)).coalesce(1).write.mode("append").text(path)
        time.sleep(0.05)
    src.end_marks(spark.createDataFrame([(0, 6, 49, 1.0, 2.0)], SCHEMA)).coalesce(1).write.mode("append").text(path)
    session = pl.stateful_session(spark)
    stream = src.stream_batches(session, path)
    got = pl.run_to_files(pl.tumbling(stream, P, delay_windows=1), spark, "t").collect()
    assert {r["window_no"]: r["size"] for r in got} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    given = samples(spark, windows=40).filter("stream_id = 0")
    path, out, state = (str(tmp_path / n) for n in ("wire", "out", "state"))
    session = pl.stateful_session(spark)

    def run():
        query = (
            pl.signal_results(src.stream_batches(session, path), P)
            .writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for low, high in ((0, 13), (13, 29), (29, 40)):
        part = given.filter(f"batch_no >= {low} and batch_no < {high}")
        src.to_batches(part).coalesce(1).write.mode("append").text(path)
        time.sleep(0.05)
        run()
    src.end_marks(given).coalesce(1).write.mode("append").text(path)
    run()
    want = de.detect_all_rows(fe.features(given, P), P)
    got = spark.read.parquet(out).select(want.columns)
    assert rows_of(got.na.fill(-9)) == rows_of(want.na.fill(-9))


def test_sorter_releases_in_order(spark):
    given = samples(spark, windows=20)
    session = pl.stateful_session(spark)
    path, files = write_replay(spark, given, P, shuffle_within=P.max_latency)
    stream = src.stream_batches(session, path, files)
    got = pl.run_to_files(pl.sort_by_event_time(stream, P, P.max_latency + 1), spark, "t")
    columns = ["stream_id", "i", "voltage", "current"]
    assert rows_of(got.select(columns)) == rows_of(given.select(columns))
    # Within every output file the rows of each window are in time order.
    files_of = got.select("*", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"))
    last = {}
    for r in files_of.orderBy("at").collect():
        key = (r["f"], r["stream_id"], r["i"] // P.w1)
        assert r["i"] > last.get(key, -1)
        last[key] = r["i"]


def test_end_marks_close_streams_of_any_length(spark):
    given = samples(spark, windows=3)
    session = pl.stateful_session(spark)
    path, files = write_replay(spark, given, replace(P, max_latency=20), shuffle_within=2)
    stream = src.stream_batches(session, path, files)
    got = pl.run_to_files(pl.tumbling(stream, P, 21), spark, "t")
    assert got.count() == 6 and got.agg(F.sum("size")).first()[0] == given.count()


def test_streams_have_clocks_of_their_own(spark, tmp_path):
    """One stream is a thousand windows ahead and ends early; the other loses nothing."""
    path, per = str(tmp_path / "wire"), P.w1
    def send(rows, ended=()):
        texts = src.to_batches(spark.createDataFrame(rows, SCHEMA))
        for e in ended:
            texts = texts.unionByName(src.end_marks(spark.createDataFrame([(e, 9999, 0, 0.0, 0.0)], SCHEMA)))
        texts.coalesce(1).write.mode("append").text(path)
        time.sleep(0.05)
    for w in range(6):
        rows = [(0, w, w * per + k, 1.0, 2.0) for k in range(per)]
        rows += [(1, 1000 + w, (1000 + w) * per + k, 1.0, 2.0) for k in range(per)] if w < 3 else []
        send(rows, ended=[1] if w == 2 else [])
    send([(2, 0, 1, 1.0, 2.0)], ended=[0])
    got = pl.run_to_files(pl.signal_features(src.stream_batches(pl.stateful_session(spark), path), P), spark, "t").collect()
    assert {(r["stream_id"], r["window_no"]) for r in got} == {(0, w) for w in range(6)} | {(1, 1000 + w) for w in range(3)}


def test_small_slices_and_many_groups(spark):
    given = samples(spark, loss=0.3, windows=50)
    session = pl.stateful_session(spark)
    path, files = write_replay(spark, given, P, shuffle_within=P.max_latency)
    got = pl.run_to_files(pl.signal_results(src.stream_batches(session, path, files), replace(P, partition=11), P.max_latency + 1), spark, "t")
    want = de.detect_all_rows(fe.locf_features(given, P), P)
    assert rows_of(got.select(want.columns).na.fill(-9)) == rows_of(want.na.fill(-9))
