"""Detection of live streams in parallel chunks: provisional results at once, corrections when the chunks before are known.

Features of a stream are numbered by one key and then dealt to keys of (stream, chunk), with the ``w2`` features before the chunk as its
context. A chunk reports every feature at once, as if the detection window began with the chunk. When it is complete it reports its transfer
map (each possible window start to the one it hands on) with the events of all starts, and its state goes. The stream's key composes the maps
in chunk order; maps that come early wait. Where the true start shows other events than the provisional one, corrected
rows follow: a later ``version`` of a row replaces an earlier one. So all detection of a busy stream runs in as many tasks as it
has open chunks, and the key of the whole stream sees packed rows, a few per chunk and micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wattshift.config import DetectorParams
from wattshift.functions.power import event_midpoint, int_div
from wattshift.operators.detect import WORD, summary_of
from wattshift.streaming.processors import ENDED, FEATURE_SCHEMA, SignalProcessor

_EVENTS = "t array<long>, first array<long>, last array<long>"
CHUNK_SCHEMA = f"stream_id long, chunk long, low long, high long, {_EVENTS}, mask array<long>, exits array<int>"
PACKED_SCHEMA = f"stream_id long, version int, low long, high long, {_EVENTS}"
VERIFIED_SCHEMA = "stream_id long, s long, d boolean, event_s long, event_start long, event_end long, version int"


class MarkedFeatures(SignalProcessor):
    """Numbered features, and behind a stream's last one a row of size -1 that carries their count as ``idx``."""

    def __init__(self, params: DetectorParams) -> None:
        super().__init__(params, detect=False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(rows)
        yield from super().handleInputRows(key, iter(held), timerValues)
        if any((part["last_window"] == ENDED).any() for part in held):
            yield pd.DataFrame({"stream_id": [key[0]], "idx": [int(self.state.get()[0])], "window_no": [-1], "f1": [0.0], "f2": [0.0], "size": [-1]})


class ChunkDetector(StatefulProcessor):
    """One chunk of a stream. State, until the chunk is complete: its rows in blocks as they came, and what the provisional detection carries."""

    def __init__(self, params: DetectorParams) -> None:
        self.params = params
        self.provisional = SignalProcessor(params, detect=True)
        self.summary = summary_of(params, ["stream_id"], resets=False)

    def init(self, handle) -> None:
        self.carried = handle.getValueState("carried", "entries long, count long, start long, recent binary")
        self.blocks = handle.getMapState("blocks", "entry long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stream, chunk = int(key[0]), int(key[1])
        base, size = chunk * self.params.partition, self.params.partition
        given = pd.concat(list(rows)).sort_values("idx")
        ended, given = bool(given["ended"].any()), given[~given["ended"]]
        entries, count, start, recent = self.carried.get() if self.carried.exists() else (0, 0, 0, b"")
        own = given[given["idx"] >= base]
        out = []
        if len(own):
            found, start, recent = self.provisional._detect(own[["f1", "f2"]].to_numpy(float), count, start, recent)
            events = found[found["d"]]
            out.append((stream, chunk, base + count, base + count + len(own), *[(base + events[c].astype("int64")).tolist() for c in ("s", "event_start", "event_end")], None, None))
            count += len(own)
        block = given[["idx", "f1", "f2"]].to_numpy(float)
        if count == size or ended:
            if count:
                every = np.concatenate([block, *[np.frombuffer(b).reshape(-1, 3) for (b,) in self.blocks.values()]])
                found = self.summary((stream, chunk), pd.DataFrame({"idx": every[:, 0].astype(np.int64), "f1": every[:, 1], "f2": every[:, 2]}))
                events = found[found["t"].notna()]
                out.append((stream, chunk, None, None, *[events[c].astype("int64").tolist() for c in ("t", "first", "last")],
                            [int(w) for m in events["mask"] for w in m], [int(e) for e in found["exits"].iloc[0]]))
            self.carried.clear()
            self.blocks.clear()
        else:
            if len(block):
                self.blocks.updateValue((entries,), (block.tobytes(),))
            self.carried.update((entries + 1, count, int(start), recent))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")]).astype({"low": "Int64", "high": "Int64"})

    def close(self) -> None:
        pass


class MapComposer(StatefulProcessor):
    """A stream's true window starts, chunk by chunk. State: the next chunk with its start, and the maps that came early."""

    def __init__(self, params: DetectorParams) -> None:
        self.words = len(range(0, params.w2 + 1, WORD))

    def init(self, handle) -> None:
        self.at = handle.getValueState("at", "chunk long, entry int")
        self.early = handle.getMapState("early", "chunk long", f"{_EVENTS}, mask array<long>, exits array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunk, entry = self.at.get() if self.at.exists() else (0, 0)
        out, maps = [], {}
        for part in rows:
            for r in part.itertuples(index=False):
                if r.exits is None:
                    out.append((key[0], 0, int(r.low), int(r.high), r.t, r.first, r.last))
                else:
                    maps[int(r.chunk)] = tuple([int(x) for x in v] for v in (r.t, r.first, r.last, r.mask, r.exits))
        while True:
            found = maps.pop(chunk, None)
            if found is None and self.early.containsKey((chunk,)):
                found = tuple(list(v) for v in self.early.getValue((chunk,)))
                self.early.removeKey((chunk,))
            if found is None:
                break
            changed = self.corrections(found, entry)
            if changed:
                out.append((key[0], 1, None, None, *[list(v) for v in zip(*changed)]))
            chunk, entry = chunk + 1, found[4][entry]
        for number, found in maps.items():
            if number > chunk:
                self.early.updateValue((number,), found)
        self.at.update((int(chunk), int(entry)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKED_SCHEMA.split(", ")]).astype({"low": "Int64", "high": "Int64"})

    def corrections(self, found, entry: int) -> list[tuple]:
        """(t, first, last) of the rows whose provisional result was wrong; no bounds where nothing is to be seen."""
        t, first, last, mask, _ = found

        def events(start: int) -> dict[int, tuple[int, int]]:
            word, bit = divmod(start, WORD)
            return {t[i]: (first[i], last[i]) for i in range(len(t)) if mask[i * self.words + word] >> bit & 1}

        true, shown = events(entry), events(0)
        return [(s, *true.get(s, (None, None))) for s in sorted(true.keys() | shown.keys()) if true.get(s) != shown.get(s)]

    def close(self) -> None:
        pass


def verified_results(windows: DataFrame, params: DetectorParams) -> DataFrame:
    """Result rows with a version: 0 as soon as a feature is there, 1 where the verified result differs.

    ``windows`` are closed windows with end marks (``closed_windows(..., marks=True)``, or with ``fill``).
    """
    features = windows.groupBy("stream_id").transformWithStateInPandas(MarkedFeatures(params), FEATURE_SCHEMA, "append", "none")
    ended = F.col("size") < 0
    chunk = int_div(F.col("idx"), params.partition).cast("long")
    late = ~ended & (F.col("idx") % params.partition >= params.partition - params.w2)
    dealt = features.select("stream_id", "idx", "f1", "f2", ended.alias("ended"),
                            F.explode(F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("chunk"))
    judged = dealt.groupBy("stream_id", "chunk").transformWithStateInPandas(ChunkDetector(params), CHUNK_SCHEMA, "append", "none")
    packed = judged.groupBy("stream_id").transformWithStateInPandas(MapComposer(params), PACKED_SCHEMA, "append", "none")
    every = F.when(F.col("version") == 0, F.sequence(F.col("low"), F.col("high") - 1)).otherwise(F.col("t"))
    rows = packed.select("stream_id", "version", F.explode(every).alias("s"), "t", "first", "last")
    at = (F.array_position("t", F.col("s")) - 1).cast("int")
    bounds = rows.select("stream_id", "version", "s", F.when(at >= 0, F.get("first", at)).alias("event_start"), F.when(at >= 0, F.get("last", at)).alias("event_end"))
    event_s = event_midpoint(F.col("event_start"), F.col("event_end")) + 1
    return bounds.select(
        "stream_id", "s", F.col("event_start").isNotNull().alias("d"), F.coalesce(event_s, F.lit(-1)).cast("long").alias("event_s"),
        "event_start", "event_end", "version")


def latest_results(rows: DataFrame) -> DataFrame:
    """The last version of every result, and whether it replaced a provisional one."""
    fields = [c for c in rows.columns if c not in ("stream_id", "s", "version")]
    return rows.groupBy("stream_id", "s").agg(F.max_by(F.struct(*fields), "version").alias("r"), (F.max("version") > 0).alias("corrected")).select(
        "stream_id", "s", "r.*", "corrected")
