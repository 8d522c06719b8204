from dataclasses import replace

import brute
import pytest
from series import feature_rows, steps

from wattshift.config import DetectorParams
from wattshift.operators import detect as de
from wattshift.operators.udtf import detect_steps, detect_udtf, maps_function

SMALL = DetectorParams(w2=10, partition=13, eps=0.1, fan=2)


def collected(df):
    return sorted(
        (r["stream_id"], r["s"], r["d"], r["event_s"], r["event_start"], r["event_end"])
        for r in df.collect()
    )


def expected(streams, params):
    return sorted(
        (stream, *row)
        for stream, points in streams.items()
        for row in brute.detect(points, params.eps, w2=params.w2)[0]
    )


def ordered(rows):
    return sorted(rows, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def streams():
    flat = [(0.0, 0.0)] * 400
    event_then_flat = steps(5, 40) + flat
    return {
        1: steps(1, 300),
        2: steps(2, 131, missing=0.03),
        3: event_then_flat,
        4: [(0.0, 0.0)],
        5: steps(7, 13),
        6: [(float("-inf"), 0.0)] * 30 + steps(8, 40),
    }


def test_chunked_equals_sequential(spark, streams):
    got = de.detect_all_rows(feature_rows(spark, streams), SMALL)
    assert ordered(collected(got)) == ordered(expected(streams, SMALL))


@pytest.mark.parametrize("partition", [10, 11, 22, 64, 5000])
def test_chunk_size_does_not_matter(spark, streams, partition):
    params = replace(SMALL, partition=partition)
    got = de.detect_events(feature_rows(spark, streams), params)
    want = [r for r in expected(streams, SMALL) if r[2]]
    assert sorted(
        (r["stream_id"], r["s"], True, r["event_s"], r["event_start"], r["event_end"])
        for r in got.collect()
    ) == sorted(want)


def test_table_function_equals_operator(spark, streams):
    features = feature_rows(spark, streams)
    assert ordered(collected(detect_udtf(features, SMALL))) == ordered(expected(streams, SMALL))
    whole = detect_steps(features, SMALL)
    assert ordered(collected(whole)) == ordered(expected(streams, SMALL))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan


def test_maps_are_one_row_a_chunk(spark, streams):
    chunks = de.with_context(feature_rows(spark, streams), SMALL)
    spark.udtf.register("chunk_maps", maps_function(SMALL))
    rows = spark.sql("SELECT * FROM chunk_maps(TABLE({c}) PARTITION BY (stream_id, chunk) ORDER BY idx)", c=chunks).filter("exits is not null")
    assert rows.count() == rows.select("stream_id", "chunk").distinct().count() == sum(-(-len(s) // SMALL.partition) for s in streams.values())


def test_order_of_input_rows_does_not_matter(spark, streams):
    features = feature_rows(spark, streams).orderBy("f1")
    got = de.detect_all_rows(features, SMALL)
    assert ordered(collected(got)) == ordered(expected(streams, SMALL))


def test_window_restarts(spark, streams):
    got = sorted(
        (r["stream_id"], r["idx"], r["new_start"], r["event_end"] is not None)
        for r in de.window_moves(feature_rows(spark, streams), SMALL).collect()
    )
    want = sorted(
        (stream, *move)
        for stream, points in streams.items()
        for move in brute.detect(points, SMALL.eps, w2=SMALL.w2)[1]
    )
    assert got == want


@pytest.mark.parametrize("n", [100, 101, 102, 205])
def test_full_size_windows(spark, n):
    params = DetectorParams(partition=101, eps=0.1)
    points = {0: [(0.0, 0.0)] * (n - 6) + [(5.0, 0.0)] + [(1.0, 0.0)] * 5}
    got = de.detect_all_rows(feature_rows(spark, points), params)
    assert ordered(collected(got)) == ordered(expected(points, params))


def test_empty_input(spark):
    empty = feature_rows(spark, {0: [(0.0, 0.0)]}).filter("idx < 0")
    assert de.detect_all_rows(empty, SMALL).count() == 0
    assert de.first_event(empty, SMALL).count() == 0


def test_first_event_and_order(spark, streams):
    features = feature_rows(spark, streams)
    first = {r["stream_id"]: r["s"] for r in de.first_event(features, SMALL).collect()}
    want = {}
    for r in expected(streams, SMALL):
        if r[2]:
            want.setdefault(r[0], r[1])
    assert first == want
    rows = de.sorted_results(de.detect_all_rows(features, SMALL)).collect()
    keys = [(r["stream_id"], r["s"]) for r in rows]
    assert keys == sorted(keys)
