"""Release of numbered rows in sequence: 0, 1, 2, ... of every stream; a missing number holds back what follows it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from wattshift.streaming.processors import runs


BLOCK = 4096    # numbers of a block of waiting rows


class Sequencer(StatefulProcessor):
    """State of a stream: the next number, and the rows behind a gap in blocks of ``BLOCK`` numbers, so it is as large as what the gap holds back.

    A micro-batch adds one entry to each block that it has rows of; blocks are read when their turn comes, or to drop copies once they hold more
    rows than numbers. Of rows with one number the first counts; released numbers do not come again.
    """

    def __init__(self, schema: str, number: str, key: str) -> None:
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.schema, self.number, self.key = schema, number, key
        self.rest = [c for c in self.columns if c not in (key, number)]
        kept = [c.split(maxsplit=1) for c in schema.split(", ") if c.split()[0] in self.rest]
        self.kept = ", ".join(f"{c} array<{t}>" for c, t in [("number", "long"), *kept])

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "number long")
        self.sizes = handle.getMapState("sizes", "block long", "entries long, rows long")
        self.blocked = handle.getMapState("blocked", "block long, entry long", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following = int(self.next.get()[0]) if self.next.exists() else 0
        arrived = pd.concat([part[[self.number, *self.rest]] for part in rows])
        arrived = self._first(arrived[arrived[self.number] >= following])
        numbers = arrived[self.number].to_numpy(np.int64)
        of_block = {int(numbers[p.start]) // BLOCK: p for p in runs(numbers // BLOCK)}
        # What waits never holds the next number, so nothing can go on unless it has come now.
        block = following // BLOCK if len(numbers) and numbers[0] == following else None
        while block is not None:
            given = self._first(pd.concat([self._take(block), arrived.iloc[of_block.pop(block, slice(0))]]))
            number = given[self.number].to_numpy(np.int64)
            n = int((number == following + np.arange(len(number))).sum())
            if n:
                out = given.iloc[:n].copy()
                out[self.key] = key[0]
                yield out[self.columns].infer_objects()
            following += n
            self._put(block, given.iloc[n:])
            block = block + 1 if following == (block + 1) * BLOCK else None
        for block, part in of_block.items():
            given = arrived.iloc[part]
            if self.sizes.containsKey((block,)) and self.sizes.getValue((block,))[1] + len(given) > BLOCK:
                given = self._first(pd.concat([self._take(block), given]))
            self._put(block, given)
        self.next.update((following,))

    def _first(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first row of every number, by number."""
        plain = rows.drop_duplicates(self.number).sort_values(self.number)
        rest = plain[self.rest].astype(object)
        return pd.concat([plain[[self.number]].astype("int64"), rest.where(rest.notna(), None)], axis=1)

    def _take(self, block: int) -> pd.DataFrame:
        """Take the waiting rows of a block out of the state, in the order in which they came."""
        parts = []
        if self.sizes.containsKey((block,)):
            for entry in range(self.sizes.getValue((block,))[0]):
                values = self.blocked.getValue((block, entry))
                parts.append(pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip([self.number, *self.rest], values)}))
                self.blocked.removeKey((block, entry))
            self.sizes.removeKey((block,))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[self.number, *self.rest], dtype=object)

    def _put(self, block: int, rows: pd.DataFrame) -> None:
        if len(rows):
            entries, n = self.sizes.getValue((block,)) if self.sizes.containsKey((block,)) else (0, 0)
            self.blocked.updateValue((block, entries), tuple(rows[c].tolist() for c in [self.number, *self.rest]))
            self.sizes.updateValue((block,), (entries + 1, n + len(rows)))

    def close(self) -> None:
        pass


def in_sequence(results: DataFrame, schema: str, number: str = "s", key: str = "stream_id") -> DataFrame:
    """Rows of each stream as soon as all smaller numbers have come; ``schema`` names the columns to keep, with key and number."""
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = results.select(*columns).filter(f"{key} is not null and {number} is not null")
    return rows.groupBy(key).transformWithStateInPandas(Sequencer(schema, number, key), schema, "append", "none")
