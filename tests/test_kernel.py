import json
import os

import brute
import numpy as np
import pytest
from series import steps

from wattshift.operators import kernel

DATA = os.path.join(os.path.dirname(__file__), "data")


def follow(points, eps, w2=100):
    xy = np.array(points, dtype=float).reshape(-1, 2)
    xy = np.concatenate([np.full((w2, 2), np.nan), xy])
    first, last = kernel.window_intervals(xy[:, 0], xy[:, 1], w2, eps, 1.0 - 0.8)
    return kernel.follow_starts(first, last, w2, {0: 1})


# Clusters (n, u, v, loc), noise, whole-window event, series event.
GOLDEN = {
    "352": ([(61, 0, 60, 1.0), (36, 62, 100, 0.923)], [61, 64, 66, 70], (61, 62), (65, 62, 61, 62)),
    "431": ([(94, 0, 97, 0.959), (2, 99, 100, 1.0)], [33, 37, 38, 42, 98], (99, 99), (100, 100, 99, 99)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_recorded_windows(name):
    with open(os.path.join(DATA, f"window_{name}.json")) as f:
        points = json.load(f)
    clusters, noise, window, event = GOLDEN[name]
    groups, alone = brute.components(points, 0.03)
    assert alone == noise
    assert [
        (len(g), g[0], g[-1], round(len(g) / (g[-1] - g[0] + 1.0), 3)) for g in groups
    ] == clusters
    assert brute.predict(points, 0.03) == window
    moves, _ = follow(points, 0.03)
    t, _, a, b, _ = moves[0]
    assert len(moves) == 1 and (t, (a + b) // 2 + 1, a, b) == event


@pytest.mark.parametrize("seed", range(60))
def test_series_equal_plain_detector(seed):
    w2 = [6, 10, 15, 25, 40][seed % 5]
    points = steps(seed, 30 + seed, missing=0.02 * (seed % 2))
    rows, restarts = brute.detect(points, 0.1, w2=w2)
    moves, _ = follow(points, 0.1, w2)
    assert [(m[0], m[1], m[2] is not None) for m in moves] == restarts
    assert {m[0]: m[2:4] for m in moves if m[2] is not None} == {
        r[0]: r[3:5] for r in rows if r[1]
    }


def test_chains_that_meet_share_their_moves():
    points = steps(3, 80)
    xy = np.array(points)
    w2 = 10
    first, last = kernel.window_intervals(xy[:, 0], xy[:, 1], w2, 0.1, 1.0 - 0.8)
    starts = {-e: 1 << e for e in range(w2 + 1)}
    moves, exits = kernel.follow_starts(first, last, w2, starts)
    for e in range(w2 + 1):
        alone, out = kernel.follow_starts(first, last, w2, {-e: 1})
        assert [m[:4] for m in moves if m[4] >> e & 1] == [m[:4] for m in alone]
        assert [s for s, m in exits if m >> e & 1] == [s for s, _ in out]


def test_no_candidate_has_a_loss():
    for seed in range(30):
        points = steps(seed, 40)
        assert all(brute.loss(*c) == 0 for c in brute.candidates(points, 0.1))


def test_long_series_in_one_sweep():
    # Positions in the sweep's tables exceed 16 bits here.
    points = steps(2, 1500, change=0.03)
    rows, restarts = brute.detect(points, 0.1, w2=40)
    moves, _ = follow(points, 0.1, 40)
    assert [(m[0], m[1], m[2] is not None) for m in moves] == restarts
    assert {m[0]: m[2:4] for m in moves if m[2] is not None} == {r[0]: r[3:5] for r in rows if r[1]}
