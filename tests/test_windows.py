"""Clustering, event model and frames in their relational form."""

import brute
import pytest
from pyspark.sql import functions as F
from series import feature_rows, steps

from wattshift.config import DetectorParams
from wattshift.operators import clustering as cl
from wattshift.operators import events as ev
from wattshift.operators import frames as fr

P = DetectorParams(eps=0.1)
KEYS = ["stream_id", "window_id"]
N = 30


@pytest.fixture(scope="module")
def windows():
    return {(s, 0): steps(s, N - s % 7, missing=0.02) for s in range(40)}


@pytest.fixture(scope="module")
def points(spark, windows):
    return fr.window_points(
        feature_rows(spark, {s: p for (s, _), p in windows.items()}), N
    ).cache()


def test_clusters(points, windows):
    got = {}
    for r in cl.cluster_assign(points, KEYS, P).collect():
        got.setdefault((r["stream_id"], r["window_id"]), {})[r["pos"]] = r["cluster_id"]
    for key, xy in windows.items():
        groups, noise = brute.components(xy, P.eps)
        want = {p: -1 for p in noise} | {p: c for c, g in enumerate(groups) for p in g}
        assert got[key] == want


def test_neighbours_and_noise(points, windows):
    near = cl.eps_neighbours(points, KEYS, P)
    noise = {(r["stream_id"], r["pos"]) for r in cl.noise_points(points, KEYS, P).collect()}
    assert noise == {(s, p) for (s, _), xy in windows.items() for p in brute.components(xy, P.eps)[1]}


def test_pairs_at_exactly_eps_are_found(spark):
    # Points eps apart whose quotients by eps round to cells two apart.
    rows = [(0, 0, k, k * 0.1, 0.0) for k in range(60)]
    df = spark.createDataFrame(rows, "stream_id long, window_id long, pos int, f1 double, f2 double")
    near = {(r["a"], r["b"]) for r in cl.eps_neighbours(df, KEYS, P).collect()}
    want = {
        (a, b) for a in range(60) for b in range(60) if a != b and abs(a * 0.1 - b * 0.1) <= 0.1
    }
    assert near == want


def test_candidates_loss_and_choice(points, windows):
    assigned = cl.cluster_assign(points, KEYS, P).cache()
    found = ev.event_candidates(assigned, KEYS, P)
    got = sorted((r["stream_id"], tuple(r["interval"])) for r in found.collect())
    assert got == sorted(
        (s, tuple(c[2])) for (s, _), xy in windows.items() for c in brute.candidates(xy, P.eps)
    )
    best = ev.best_candidate(ev.candidate_loss(found, assigned, KEYS), KEYS, P).collect()
    want = {s: brute.best(xy, P.eps) for (s, _), xy in windows.items()}
    assert {r["stream_id"]: (r["first"], r["last"]) for r in best} == {
        s: (b[0], b[-1]) for s, b in want.items() if b
    }


def test_loss_counts_members_on_the_wrong_side(spark):
    assigned = spark.createDataFrame(
        [(0, 0, p, c) for p, c in enumerate([0, 0, 1, -1, 0, 1, -1, 1, 0])],
        "stream_id long, window_id long, pos int, cluster_id int",
    )
    given = spark.createDataFrame(
        [(0, 0, 0, 1, [3, 6])], "stream_id long, window_id long, c1 int, c2 int, interval array<int>"
    )
    r = ev.candidate_loss(given, assigned, KEYS).first()
    # c2 at 2 is before the interval, c1 at 8 after it, 4 and 5 inside.
    assert (r["a"], r["b"], r["c"], r["loss"]) == (1, 1, 2, 4)
    strict = DetectorParams(loss_thresh=3)
    assert ev.best_candidate(ev.candidate_loss(given, assigned, KEYS), KEYS, strict).count() == 0


def test_backward_pass_two_ways(points, windows):
    want = {
        s: e for (s, _), xy in windows.items() if (e := brute.predict(xy, P.eps)) is not None
    }
    assert len(want) > 3
    for df in (ev.backward_pass(points, KEYS, P), ev.detect_window(points, KEYS, P)):
        got = {r["stream_id"]: (r["event_start"], r["event_end"]) for r in df.collect()}
        assert got == want


def test_trailing_buffer_across_chunks(spark):
    small = DetectorParams(w2=2, partition=5)
    df = feature_rows(spark, {0: [(0.0, 0.0)] * 500, 1: [(0.0, 0.0)] * 3})
    got = {(r["stream_id"], r["idx"]): (r["buffered"], r["first_idx"])
           for r in fr.trailing_buffer(df, small).collect()}
    assert got == {
        (s, t): (min(t + 1, 26), max(0, t - 25)) for s, n in ((0, 500), (1, 3)) for t in range(n)
    }


def test_overlap_partitions(spark):
    small = DetectorParams(w2=4, partition=10)
    df = fr.overlap_partitions(feature_rows(spark, {0: [(0.0, 0.0)] * 33}), small)
    got = sorted((r["part_key"], r["part_offset"], r["idx"]) for r in df.collect())
    want = sorted(
        [(t // 10, t % 10, t) for t in range(33)]
        + [(t // 10 - 1, 10 + t % 10, t) for t in range(10, 33) if t % 10 < 4]
    )
    assert got == want
    kept = fr.overlap_suppress(df, small).select(F.col("idx")).collect()
    assert sorted(r[0] for r in kept) == list(range(33))
