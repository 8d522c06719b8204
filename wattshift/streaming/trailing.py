"""The buffer of a live stream's last features, kept in state for lookups by global index.

A buffer is a run of blocks under ascending numbers. New features become new blocks and are never rewritten; a block goes
when all its features have left the buffer, so state is as large as the buffer, however long the stream is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from wattshift.config import DetectorParams

TRAILING_SCHEMA = "stream_id long, idx long, buffered long, first_idx long, low double, high double"


class TrailingBuffer(StatefulProcessor):
    """Features of a stream arrive in the order of ``idx``, dense from 0. Per feature: size, first index and range of ``f1`` of the
    buffer that ends with it. Memory: the buffer and one slice of ``length`` features."""

    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle) -> None:
        self.bounds = handle.getValueState("bounds", "first_block long, next_block long, next_idx long")
        self.blocks = handle.getMapState("blocks", "block long", "last_idx long, features binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, following, count = self.bounds.get() if self.bounds.exists() else (0, 0, 0)
        kept = [np.frombuffer(self.blocks.getValue((b,))[1]).reshape(-1, 2) for b in range(first, following)]
        held = np.concatenate([np.empty((0, 2)), *kept])[-self.length:]
        for part in rows:
            for at in range(0, len(part), self.length):
                new = part.iloc[at: at + self.length]
                if new["idx"].iloc[0] != count or new["idx"].iloc[-1] != count + len(new) - 1:
                    raise ValueError(f"stream {key[0]}: features must arrive in order, {count} is next")
                values = new[["f1", "f2"]].to_numpy(float)
                both = np.concatenate([held, values])
                frame = pd.Series(both[:, 0]).rolling(self.length, min_periods=1)
                idx = np.arange(count, count + len(new))
                size = np.minimum(idx + 1, self.length)
                yield pd.DataFrame({"stream_id": key[0], "idx": idx, "buffered": size, "first_idx": idx - size + 1,
                                    "low": frame.min().to_numpy()[len(held):], "high": frame.max().to_numpy()[len(held):]})
                count += len(new)
                self.blocks.updateValue((following,), (count - 1, np.ascontiguousarray(values).tobytes()))
                following, held = following + 1, both[-self.length:]
        while self.blocks.containsKey((first,)) and self.blocks.getValue((first,))[0] < count - self.length:
            self.blocks.removeKey((first,))
            first += 1
        self.bounds.update((int(first), int(following), int(count)))

    def close(self) -> None:
        pass


def stream_trailing(features: DataFrame, params: DetectorParams, keep: int = 12) -> DataFrame:
    """The buffer of the last ``keep * w2 + 2`` features behind every feature of a live series (``signal_features``)."""
    return features.select("stream_id", "idx", "f1", "f2").groupBy("stream_id").transformWithStateInPandas(
        TrailingBuffer(keep * params.w2 + 2), TRAILING_SCHEMA, "append", "none")
