"""Random step series with noise, outliers and missing values."""

import random


def steps(seed, n, change=0.1, spread=0.05, outliers=0.15, missing=0.0):
    rng = random.Random(seed)
    level, out = 0.0, []
    for _ in range(n):
        if rng.random() < change:
            level = rng.choice([0.0, 1.0, 2.0, 3.0])
        x = level + rng.gauss(0, spread)
        if rng.random() < outliers:
            x += rng.choice([0.5, -0.7, 9.0])
        if rng.random() < missing:
            x = float("nan")
        out.append((x, rng.gauss(0, spread)))
    return out


def feature_rows(spark, streams):
    rows = [
        (stream, t, x, y) for stream, points in streams.items() for t, (x, y) in enumerate(points)
    ]
    return spark.createDataFrame(rows, "stream_id long, idx long, f1 double, f2 double")
