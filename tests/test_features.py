import math
import random
from dataclasses import replace

import pytest

from wattshift.config import DetectorParams
from wattshift.operators import features as fe
from wattshift.operators.ordering import number_rows, row_chunks
from pyspark.sql import functions as F

P = DetectorParams(w1=8, feature_block=3, carry_block=4)
SCHEMA = "stream_id long, batch_no long, i long, voltage double, current double"


def ln(x):
    return math.log(x) if x > 0 else float("-inf") if x == 0 else float("nan")


def plain_features(rows, w1, fill):
    """Windows in order; short ones after the first take every last-known slot."""
    out = []
    for stream in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == stream)
        held, idx = {}, 0
        for w in sorted({r[2] // w1 for r in mine}):
            batch = [r for r in mine if r[2] // w1 == w]
            for r in sorted(batch, key=lambda r: (r[2], r[1], r[3], r[4])):
                held[r[2] % w1] = (r[3], r[4])
            used = [(r[3], r[4]) for r in batch]
            if fill and idx and len(batch) < w1:
                used = list(held.values())
            n = len(used)
            p = sum(v * c for v, c in used) / n
            s = math.sqrt(sum(v * v for v, _ in used) / n) * math.sqrt(sum(c * c for _, c in used) / n)
            q2 = s * s - p * p
            q = math.sqrt(q2) if q2 >= 0 else float("nan")
            out.append((stream, idx, w, ln(p), ln(q), n))
            idx += 1
    return out


def close(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9)


def check(spark, rows, params, fill):
    make = fe.locf_features if fill else fe.features
    got = sorted(tuple(r) for r in make(spark.createDataFrame(rows, SCHEMA), params).collect())
    want = plain_features(rows, params.w1, fill)
    assert [(g[0], g[1], g[2], g[5]) for g in got] == [(w[0], w[1], w[2], w[5]) for w in want]
    assert all(close(g[3], w[3]) and close(g[4], w[4]) for g, w in zip(got, want))


def samples(seed, streams=3, windows=30, w1=8, loss=0.2, lost_windows=(), copies=0):
    rng = random.Random(seed)
    rows = []
    for stream in range(streams):
        for i in range(windows * w1):
            if i // w1 in lost_windows or rng.random() < loss:
                continue
            r = (stream, i // w1, i, rng.uniform(1, 9), rng.uniform(1, 9))
            rows.append(r)
            if rng.random() < 0.05:  # the same sample again, with another reading
                rows.append((stream, i // w1 + 1, i, rng.uniform(1, 9), rng.uniform(1, 9)))
    rows += [rows[len(rows) // 2]] * copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fill", [False, True])
def test_complete_samples(spark, fill):
    check(spark, samples(1, loss=0.0), P, fill)


@pytest.mark.parametrize("seed", range(3))
def test_missing_samples_and_windows(spark, seed):
    lost = (0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20)
    check(spark, samples(seed, loss=0.4, lost_windows=lost), P, True)


def test_often_copied_sample(spark):
    check(spark, samples(4, copies=500), P, True)


def test_slots_never_seen_stay_out(spark):
    rows = [(0, i // 8, i, 2.0, 3.0 + i % 3) for i in range(80) if i % 8 < 5]
    check(spark, rows, P, True)


def test_zero_power_and_nan(spark):
    rows = [(0, i // 8, i, 0.0, 1.0 + i) for i in range(8)]
    rows += [(0, 1, 8 + i, float("nan"), 1.0) for i in range(8)]
    rows += [(0, 2, 16 + i, 2.0, 1.0 + i) for i in range(3)]
    got = sorted(tuple(r) for r in fe.locf_features(spark.createDataFrame(rows, SCHEMA), P).collect())
    assert got[0][3] == float("-inf") and math.isnan(got[1][3])
    check(spark, rows, P, True)


def test_without_log(spark):
    df = fe.features(spark.createDataFrame(samples(2, loss=0.0), SCHEMA), replace(P, use_log=False))
    assert all(r["f1"] > 5 for r in df.collect())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fe.features(empty, P).count() == 0 and fe.locf_features(empty, P).count() == 0


def test_number_rows_by_blocks(spark):
    rows = [(s, k * k + s) for s in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "stream_id long, at long")
    got = number_rows(df, ["stream_id"], ["at"], F.expr("at div 50")).collect()
    want = {(s, at): n for s in range(3) for n, at in enumerate(sorted(a for t, a in rows if t == s))}
    assert {(r["stream_id"], r["at"]): r["idx"] for r in got} == want


def test_row_chunks_with_copies(spark):
    rows = [(0, k // 3) for k in range(50)] + [(1, 7)] * 95
    df = spark.createDataFrame(rows, "stream_id long, at long")
    got = row_chunks(df, ["stream_id"], ["at"], 10, F.expr("at div 4"), piece=20)
    for s in (0, 1):
        mine = sorted((r["row_no"], r["at"], r["chunk"]) for r in got.collect() if r["stream_id"] == s)
        ats = sorted(a for t, a in rows if t == s)
        assert mine == [(n, a, n // 10) for n, a in enumerate(ats)]
