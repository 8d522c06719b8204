"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if a string of ``span`` bytes that covers it also starts earlier: in a document with a smaller id, or earlier in
the same document. Strings do not cross documents.

1. Every string has one anchor: the least 32-bit hash among its ``gram``-byte substrings, the left-most if equal. Neighbouring strings
   share anchors, so a text becomes a few rows, one per anchor with the range of strings it stands for. Equal
   strings have equal anchors, so all that follows can be done anchor by anchor.
2. Rows with the same anchor and the same text around it are compared first inside a task, then by one shuffle: of equal rows only
   the earliest stays, the others' strings are all repeated.
3. What is left are different texts around one anchor. Their bytes, about 100 around the anchor, are sent to the shard of the anchor;
   an anchor with many texts is split by the bytes before and behind it. A shard's text goes to a file and is suffix-sorted by external induction (module induced). Suffixes whose common
   prefix is ``span`` or more are the same string; the earliest is kept, the others are repeated.
4. The ranges of a document are merged and cut out.

A task never holds a group: rows are streamed in sorted order, shards live in files. Hot strings are thinned in the tasks
that read them, before the shuffle.

Defined cases: null text counts as empty and loses nothing; null ids come before all others; rows with one id and different
text are ordered by the text's hash; rows with one id and one text are one document and get the same result; texts shorter than ``span`` lose nothing;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import Powers, chunks, mix, partitions, prefix_hash, settle
from wattshift.llm.induced import Shard
from wattshift.session import scratch_path

SPAN = 100
GRAM = 20
BROADCAST_RANGES = 3_000_000    # ranges to fetch up to which they are broadcast, about 100 MB; joined by shuffle beyond
THIN_ROWS = 4000                # documents whose equal rows are thinned together before the shuffle
HOT_TEXTS = 1000                # different texts around one anchor beyond which its strings go to several shards
NO_ID = -(1 << 63)
WIDTH = 128                     # at = first string * WIDTH + number of strings; a row stands for SPAN - GRAM + 1 at most

ROWS = "route long, seg long, k_id long, k_text long, at long, kind int"
REPEATED, UNIQUE, OPEN = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_text"), "text")


def anchors(data: np.ndarray, ends: np.ndarray, span: int, gram: int, tables: Powers):
    """(hash of anchor, hash of the row's text, document, first string, strings, place of anchor) of the rows of a chunk."""
    n, width = len(data), span - gram + 1
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    h = prefix_hash(data, tables)
    _, down = tables.get(n + 1)
    grams = mix((h[gram:] - h[:-gram]) * down[: n - gram + 1])
    places = np.uint64((1 << 32) - 1)      # anchors are told apart by the upper half of the hash, in a text of any size
    least = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach:])
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(least)]
    inside = np.flatnonzero(ends[doc + 1] - start >= span)
    if not len(inside):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    at, doc = (least[inside] & places).astype(np.int64), doc[inside]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(inside)))
    low, anchor = inside[first], at[first]
    high = low + count + span - 1
    seg = mix((h[high] - h[low]) * down[low] + (anchor - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return grams[anchor], seg, doc[first], low - ends[doc[first]], count, anchor - ends[doc[first]]


def _rows(span: int, gram: int):
    """Rows of the anchors; of rows that are equal inside the batch, all but the earliest come out as repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in (b.slice(at, THIN_ROWS) for b in batches for at in range(0, b.num_rows, THIN_ROWS)):
            found = []
            for part, data, ends in chunks(batch):
                anchor, seg, doc, low, count, _ = anchors(data, ends, span, gram, tables)
                found.append((anchor.view(np.int64), seg.view(np.int64), part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc], low * WIDTH + count))
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found)]
            columns = [c[order] for order in [np.lexsort(columns[::-1])] for c in columns]
            first = _changes(columns[:2])
            kind = np.where(_differs(columns[2:], first), REPEATED, UNIQUE)
            copy = ~first & (kind == UNIQUE)          # the same place of a repeated row
            kind, columns = kind[~copy], [c[~copy] for c in columns]
            done = kind == REPEATED
            columns[0] = np.where(done, mix(columns[2].view(np.uint64)).view(np.int64), columns[0])
            yield _batch([*columns, kind.astype(np.int32)], ("route", "seg", "k_id", "k_text", "at", "kind"))
    return run


def _batch(columns: list[np.ndarray], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names))


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _differs(place: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Rows whose place is another one than that of the first row of their group."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    out = np.zeros(len(first), bool)
    for c in place:
        out |= c != c[head]
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (route, seg, place). Comes out: repeated rows, and as open the earliest row of every text of an
    anchor that has several. Between batches only one row is carried."""
    carried: list[np.ndarray] | None = None
    held = False              # the carried row is the only text of its anchor so far and has not come out
    names = ("route", "k_id", "k_text", "at", "kind")
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        done = columns[5] == REPEATED
        if done.any():
            yield _batch([columns[i][done] for i in (0, 2, 3, 4, 5)], names)
            columns = [c[~done] for c in columns]
        if not len(columns[0]):
            continue
        if carried is not None:
            columns = [np.concatenate((a, b)) for a, b in zip(carried, columns)]
        first = _changes(columns[:2])
        repeated = _differs(columns[2:5], first) & ~first
        if repeated.any():
            yield _batch([*[columns[i][repeated] for i in (0, 2, 3, 4)], np.full(repeated.sum(), REPEATED, np.int32)], names)
        heads = np.flatnonzero(first)
        route = columns[0][heads]
        later = np.concatenate(([False], route[1:] == route[:-1]))
        more = np.concatenate((route[1:] == route[:-1], [False]))
        out = later | more
        if carried is not None and not held:
            out[0] = False                             # it came out with an earlier batch
        if out.any():
            at = heads[out]
            yield _batch([*[columns[i][at] for i in (0, 2, 3, 4)], np.full(len(at), OPEN, np.int32)], names)
        came_out = out[-1] or (carried is not None and not held and len(heads) == 1)
        carried, held = [c[heads[-1]: heads[-1] + 1] for c in columns], not came_out


def _halves(raw: bytes, route: int, span: int, gram: int, tables: Powers) -> list[tuple[int, int, int]]:
    """(route, first string, strings) of a segment whose anchor is hot: strings that reach far before the anchor go by the
    bytes before it, the others by the bytes behind it. Equal strings agree on these bytes."""
    data = np.frombuffer(raw, np.uint8)
    _, _, _, low, count, place = anchors(data, np.array([0, len(raw)]), span, gram, tables)
    (first, n, at), far = (int(x[0]) for x in (low, count, place)), (span - gram) // 2
    near = max(first, min(first + n, at - far + 1))       # strings before this one start at least far bytes ahead of the anchor
    out = []
    for start, stop, side in ((first, near, raw[at - far: at]), (near, first + n, raw[at + gram: at + gram + far])):
        if stop > start:
            out.append((int.from_bytes(hashlib.blake2b(side, digest_size=8, key=route.to_bytes(8, "little", signed=True)).digest(), "little", signed=True),
                        start, stop - start))
    return out


def _segments(span: int, gram: int):
    """Bytes of the open rows of a document; a negative place marks a hot anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out = [[], [], [], [], []]
                part = batch.slice(at, 100)
                for k_id, k_text, text, ranges in zip(*[c.to_pylist() for c in part.columns[:3]], part.column(3)):
                    raw = text.encode()
                    routes, places = (ranges.values.field(n).to_pylist() for n in ("route", "at"))
                    for route, place in zip(routes, places):
                        low, count = divmod(abs(place), WIDTH)
                        parts = [(route, 0, count)] if place >= 0 else _halves(raw[low: low + count + span - 1], route, span, gram, tables)
                        for to, first, n in parts:
                            start = low + first
                            for o, v in zip(out, (to, k_id, k_text, start * WIDTH + n, raw[start: start + n + span - 1])):
                                o.append(v)
                yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.binary())],
                                                 ["route", "k_id", "k_text", "at", "bytes"])
    return run


def _least_first(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c[order] for order in [np.lexsort(columns[::-1])] for c in columns]


def _runs(rows: np.ndarray, begins: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of marked strings inside every row (k_id, k_text, at) from its place in the shard on."""
    for a in range(0, len(rows), THIN_ROWS):
        (k_id, k_text, at), begin = rows[a: a + THIN_ROWS].T, begins[a: a + THIN_ROWS]
        count = at % WIDTH
        stops = np.cumsum(count)
        row = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(row)) - np.repeat(stops - count, count)
        marked = gone[begin[row] + offset]
        row, offset = row[marked], offset[marked]
        fresh = _changes([row, offset - np.arange(len(offset))])
        heads = np.flatnonzero(fresh)
        if len(heads):
            length = np.diff(np.append(heads, len(row)))
            row, start = row[heads], (at // WIDTH)[row[heads]] + offset[heads]
            yield _batch([k_id[row], k_text[row], start * WIDTH + length], ("k_id", "k_text", "at"))


def _sorted_shard(span: int, memory: int):
    """A partition's segments as one text in a file, suffix-sorted; the repeated strings as (k_id, k_text, at).

    Strings of one group share their first span bytes; groups come one after another, and from block to block only the
    earliest string of the last group is carried. Repeated strings are marked in a file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:     # of the task alone, gone when it ends
            size = n_rows = 0
            files = [os.path.join(folder, name) for name in ("text", "rows", "begins")]
            with open(files[0], "wb") as f, open(files[1], "wb") as g, open(files[2], "wb") as h:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    raw = batch.column(4).to_pylist()
                    for b in raw:
                        f.write(b"\0" + b)                # any letter parts; strings never reach beyond their segment
                    begin = size + np.cumsum([0, *[len(b) + 1 for b in raw]])
                    g.write(np.stack([c.to_numpy() for c in batch.columns[1:4]], 1).tobytes())
                    h.write((begin[:-1] + 1).tobytes())
                    size, n_rows = int(begin[-1]), n_rows + len(raw)
            if not size:
                return
            text = np.memmap(files[0], np.uint8, "r")
            rows, begins = np.memmap(files[1], np.int64, "r", shape=(n_rows, 3)), np.memmap(files[2], np.int64, "r")
            gone = np.memmap(os.path.join(folder, "gone"), np.bool_, "w+", shape=size)
            groups, earliest = 0, [np.zeros(0, np.int64)] * 5     # group, k_id, k_text, first string, place in the shard
            for positions, prefix in Shard(text, span, folder, memory).order():
                group = groups + np.cumsum(prefix < span)
                groups = int(group[-1])
                row = np.searchsorted(begins, positions, "right") - 1
                k_id, k_text, at = rows[np.maximum(row, 0)].T
                offset = positions - begins[np.maximum(row, 0)]
                string = (row >= 0) & (offset < at % WIDTH)
                found = [x[string] for x in (group, k_id, k_text, at // WIDTH + offset, positions)]
                columns = _least_first([np.concatenate(x) for x in zip(earliest, found)])
                if not len(columns[0]):
                    continue
                first = _changes(columns[:1])
                gone[columns[4][_differs(columns[1:4], first)]] = True
                head = np.flatnonzero(first)[-1:]
                earliest = [c[head] for c in columns]
            yield from _runs(rows, begins, gone)
    return run


def _cut(span: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 200):
                part = batch.slice(piece, 200)
                n_bytes, n_removed, n_spans, digest, texts = [], [], [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2)):
                    raw = (text or "").encode()
                    runs = []
                    if ranges.is_valid:
                        at = np.sort(ranges.values.to_numpy())
                        low, stop = at // WIDTH, np.maximum.accumulate(at // WIDTH + at % WIDTH + span - 1)
                        new = np.concatenate(([True], low[1:] > stop[:-1]))
                        runs = list(zip(low[new].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)].tolist()))
                    kept, last = [], 0
                    for a, b in runs:
                        kept.append(raw[last:a])
                        last = b
                    left = b"".join([*kept, raw[last:]])
                    n_bytes.append(len(raw))
                    n_removed.append(len(raw) - len(left))
                    n_spans.append(len(runs))
                    digest.append(hashlib.sha256(left).hexdigest())
                    texts.append(left if full else None)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(digest, pa.string()), pa.array(texts, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_ranges(docs: DataFrame, span: int = SPAN, gram: int = GRAM, memory: int = 1 << 22) -> DataFrame:
    """(k_id, k_text, at) over keyed documents: the strings first..first+n-1 with at = first * WIDTH + n are repeated."""
    if not 0 <= span - gram < WIDTH - 1:
        raise ValueError(f"span may exceed gram by {WIDTH - 2} at most")
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select("k_id", "k_text", "text")
    rows = (texts.mapInArrow(_rows(span, gram), ROWS).repartition(n, "route")
            .sortWithinPartitions("route", "seg", "k_id", "k_text", "at"))
    path = scratch_path(spark, "suffix-rows")
    resolved = rows.mapInArrow(_resolve, "route long, k_id long, k_text long, at long, kind int")
    resolved.write.parquet(path)
    known = spark.read.schema(resolved.schema).parquet(path)
    open_ = known.filter(F.col("kind") == OPEN)
    hot = settle(open_.groupBy("route").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > HOT_TEXTS))
    marked = open_.join(hot, "route", "left").withColumn("at", F.when(F.col("texts").isNull(), F.col("at")).otherwise(-F.col("at")))
    wanted = marked.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("route", "at")).alias("ranges"))
    if open_.count() <= BROADCAST_RANGES:
        wanted = F.broadcast(wanted)
    segments = (texts.join(wanted, ["k_id", "k_text"]).select("k_id", "k_text", "text", "ranges")
                .mapInArrow(_segments(span, gram), "route long, k_id long, k_text long, at long, bytes binary"))
    found = segments.repartition(n, "route").mapInArrow(_sorted_shard(span, memory), "k_id long, k_text long, at long")
    return known.filter(F.col("kind") == REPEATED).select("k_id", "k_text", "at").unionByName(found)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes."""
    rows = keyed(docs)
    ranges = repeated_ranges(rows, span, gram).groupBy("k_id", "k_text").agg(F.collect_list("at").alias("ranges"))
    return (rows.join(ranges, ["k_id", "k_text"], "left").select("doc_id", "text", "ranges")
            .mapInArrow(_cut(span, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
