from dataclasses import replace

import brute
from series import feature_rows, steps

from wattshift.config import DetectorParams
from wattshift.operators import detect as de
from wattshift.operators import reconcile as rc

P = DetectorParams(w2=10, partition=14, eps=0.1)


def test_partitions_judged_alone(spark):
    points = {0: steps(1, 100), 3: steps(9, 61)}
    got = sorted(
        (r["stream_id"], r["s"], r["d"], r["event_s"])
        for r in rc.provisional_results(feature_rows(spark, points), P).collect()
    )
    want = []
    for stream, xy in points.items():
        for base in range(0, len(xy), P.partition):
            part = xy[base : base + P.partition + P.w2]
            for t, d, event, _, _ in brute.detect(part, P.eps, w2=P.w2)[0]:
                if base == 0 or t >= P.w2:
                    want.append((stream, base + t, d, event + base if d else -1))
    assert got == sorted(want)


def test_merge_retracts_and_replaces(spark):
    given = spark.createDataFrame(
        [(0, 1, True, 9), (0, 2, True, 8), (0, 3, False, -1), (1, 1, False, -1)],
        "stream_id long, s long, d boolean, event_s long",
    )
    truth = spark.createDataFrame([(0, 2, 7), (0, 3, 6)], "stream_id long, s long, event_s long")
    got = sorted(tuple(r) for r in rc.reconcile_merge(given, truth).collect())
    assert got == [
        (0, 1, False, -1, True), (0, 2, True, 7, False), (0, 3, True, 6, False),
        (1, 1, False, -1, False),
    ]
    left = rc.pending_minus_verified(given, truth).collect()
    assert sorted((r["stream_id"], r["s"]) for r in left) == [(0, 1), (1, 1)]


def test_release_and_sequence(spark):
    rows = [(0, s) for s in (0, 1, 2, 4, 5)] + [(1, s) for s in (1, 2)] + [(2, s) for s in range(9)]
    df = spark.createDataFrame(rows, "stream_id long, s long")
    got = sorted((r["stream_id"], r["s"]) for r in rc.contiguous_prefix(df).collect())
    assert got == [(0, 0), (0, 1), (0, 2)] + [(2, s) for s in range(9)]
    bounds = spark.createDataFrame([(0, 4), (2, 0)], "stream_id long, bound long")
    got = sorted((r["stream_id"], r["s"]) for r in rc.release_below_bound(df, bounds).collect())
    assert got == [(0, 0), (0, 1), (0, 2)]


def test_range_lookup_and_rechecks(spark):
    f = feature_rows(spark, {0: [(0.0, 0.0)] * 100})
    regions = spark.createDataFrame(
        [(0, 1, 5, 9), (0, 2, 60, 75), (0, 3, 7, 7)], "stream_id long, region_id long, a long, b long"
    )
    got = sorted((r["region_id"], r["idx"]) for r in rc.range_lookup(f, regions, bucket=8).collect())
    assert got == [(1, i) for i in range(5, 9)] + [(2, i) for i in range(60, 75)]
    small = replace(P, w2=10)
    events = spark.createDataFrame([(0, 3), (0, 95)], "stream_id long, event_end long")
    assert [r["idx"] for r in rc.recheck_points(f, events, small).collect()] == [25]
    assert rc.latest_recheck(events, small).first()["latest_recheck"] == 117


def test_detector_with_other_keys(spark):
    f = feature_rows(spark, {0: steps(1, 60), 1: steps(2, 60)}).withColumnRenamed("stream_id", "meter")
    got = de.detect_events(f, P, keys=["meter"]).collect()
    want = [
        (m, r[0]) for m in (0, 1) for r in brute.detect(steps(m + 1, 60), P.eps, w2=P.w2)[0] if r[1]
    ]
    assert sorted((r["meter"], r["s"]) for r in got) == sorted(want)
