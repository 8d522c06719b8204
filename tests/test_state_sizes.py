"""Cost of keyed state: few entries and frames however many windows or rows a micro-batch has."""

from datetime import datetime

import numpy as np
import pandas as pd

from wattshift.config import DetectorParams
from wattshift.plans import queries
from wattshift.streaming import pipeline as pl
from wattshift.streaming import processors as pr
from wattshift.streaming.sequence import Sequencer

P = DetectorParams(w1=20, w2=10, partition=22)


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()


def readings(i, clock, ended=False):
    i = np.asarray(i, np.int64)
    names = [c.split()[0] for c in pl.PACKED_READINGS.split(", ")]
    return pd.DataFrame([(0, 0, clock, ended, 0, i, i // P.w1, i * 1.5 + 1, i * 0.5 + 2)], columns=names)


def started(processor):
    processor.init(Handle())
    return processor


def test_sorter_hands_on_slices_not_windows():
    sorter = started(pr.EventTimeSorter(P, 2))
    given = np.random.default_rng(3).permutation(500 * P.w1)
    first = list(sorter.handleInputRows((0, 0), iter([readings(given, 499)]), None))
    assert len(first) == 1 and len(sorter.waiting) == 2
    rest = list(sorter.handleInputRows((0, 0), iter([readings([], 500, True)]), None))
    assert pd.concat(first + rest)["i"].tolist() == list(range(500 * P.w1))


def test_slot_sums_in_slices_equal_one_pass(monkeypatch):
    rng = np.random.default_rng(4)
    given = [i for i in range(0, 400 * P.w1, 2) if rng.random() < 0.2 and i // P.w1 % 9]

    def run():
        sums = started(pr.SlotSums(P, 2, 1))
        parts = [given[: len(given) // 2], given[len(given) // 2:]]
        frames = [f for part in parts for f in sums.handleInputRows((0, 0), iter([readings(part, part[-1] // P.w1)]), None)]
        return pd.concat([*frames, *sums.handleInputRows((0, 0), iter([readings([], 400, True)]), None)])

    whole = run()
    last = {}
    own = {w: [i for i in given if i // P.w1 == w] for w in range(400)}
    want = []
    for w in range(400):
        last |= {i % P.w1: i for i in own[w]}
        want.append((len(own[w]), len(last), sum((i * 1.5 + 1) * (i * 0.5 + 2) for i in last.values())))
    got = {w: (n, filled, vi) for a, b, n, filled, vi in whole[["first_window", "last_window", "n", "filled_n", "filled_vi"]].itertuples(index=False)
           for w in range(a, min(b, 399) + 1)}
    first = min(w for w in own if own[w])
    assert sorted(got) == list(range(first, 400))
    assert all(got[w][:2] == want[w][:2] and abs(got[w][2] - want[w][2]) <= 1e-9 * want[w][2] for w in got)
    monkeypatch.setattr(pr, "CELLS", 40)
    pd.testing.assert_frame_equal(run().reset_index(drop=True), whole.reset_index(drop=True))


def test_waiting_rows_share_entries():
    held = started(Sequencer("stream_id long, s long, n long", "s", "stream_id"))

    def send(numbers, n):
        return [f for f in held.handleInputRows((0,), iter([pd.DataFrame({"stream_id": 0, "s": numbers, "n": n})]), None) if len(f)]

    numbers = np.random.default_rng(5).permutation(np.arange(1, 10_000))
    assert not send(numbers, numbers) and len(held.blocked) <= 3
    for _ in range(3):
        assert not send(numbers, -1)        # copies of waiting numbers do not pile up
    assert sum(len(v[0]) for v in held.blocked.values()) <= 3 * 4096
    out = pd.concat(send([0], 0))
    assert out["s"].tolist() == list(range(10_000)) == out["n"].tolist() and not held.blocked
    assert not send([5, 10_002], 1) and pd.concat(send([10_001, 10_000], 2))["n"].tolist() == [2, 2, 1]


def test_state_partitions_do_not_follow_the_shuffle_setting(spark):
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "64")
    assert pl.stateful_session(wide).conf.get("spark.sql.shuffle.partitions") == str(spark.sparkContext.defaultParallelism)
    assert pl.stateful_session(wide, 5).conf.get("spark.sql.shuffle.partitions") == "5"


def test_unequal_clocks_beyond_a_million_windows(spark, tmp_path):
    w1 = queries.PARAMS.w1
    ids = [base + k for base in (0, 1_000_000 * w1) for k in range(6 * w1)]
    rows = [(i, datetime(2024, 1, 1), 1, "view", 2.0, '{"k": 3}') for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["stream_unequal_clocks"](spark, str(tmp_path))
    assert got.groupBy().sum("size").first()[0] == len(ids)
