"""Token ids in raw shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by id; every task encodes its documents and writes one shard:

``ids-*.bin``     the ids of its documents behind one another, little-endian, 2 bytes each if the vocabulary allows, else 4
``index-*.mph``   b"WMPH1\\n", an 8-byte length, a JSON header with the arrays' types and sizes, then the arrays

The index maps a key to a row of the shard in constant time: levels of bit arrays hold every key at a place of its own
(keys that meet go on to the next level, the few that are left are listed), a rank directory turns the place into a slot, and the
slot keeps a 32-bit fingerprint that rejects unknown keys, the first row and the number of rows of the key. ``row_start``
gives each row's place in the payload.

A task writes to names of its own attempt and reports them; only reported files belong to the store, so a repeated or
speculative task leaves nothing wrong behind. Files are opened through pyarrow's file systems at a URI below the shared
folder. The driver sees one row per shard.

Defined cases: null or empty text has just the end id; rows with one id lie behind one another (ordered by text) and are all found
by its key; a null id sorts first and is found by the null key; an empty table gives a store without shards; extra columns
are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, islice, pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.llm.common import mix, partitions, settle
from wattshift.session import scratch_path

MAGIC = b"WMPH1\n"
LEVELS = 24          # after these the few keys left are listed
SPREAD = 1.6         # places per key on a level
CACHE_PIECES = 400_000
END_ID = 0

# Fixed value: the split that byte-level BPE vocabularies of this kind make before their merges; <L> and <N> stand for letters and numbers.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[<L>]+| ?[<N>]+| ?[^\s<L><N>]+|\s+(?!\S)|\s+"""
# Characters whose letters and numbers are spelled out; texts with other ones go through the library whole, so that no Unicode table but its own decides.
USUAL = [*range(0x1C), *range(0x20, 0x85), *range(0x86, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
UNUSUAL = "[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]"


def piece_pattern() -> str:
    """PIECES with the usual letters and numbers."""
    of = lambda kind: "".join(chr(c) for c in USUAL if unicodedata.category(chr(c))[0] == kind)
    return PIECES.replace("<L>", of("L")).replace("<N>", of("N"))


class Encoder:
    """Ids of texts by the tokenizers library, as bytes of one integer type.

    For byte-level BPE the library encodes each different piece once and a bounded cache serves the rest, since merges
    never cross pieces. Other tokenizers, and texts with unusual characters, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        split = told.get("pre_tokenizer") or {}
        self.by_piece = (told["model"]["type"] == "BPE" and told.get("normalizer") is None and split.get("type") == "ByteLevel"
                         and split.get("use_regex", True) and not split.get("add_prefix_space") and not told["truncation"] and not told["padding"])
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self._number: defaultdict[str, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._ids, self._size = np.zeros(0, self.dtype), np.zeros(0, np.int64)     # of the numbered pieces, behind one another
        if self.by_piece:
            self.pieces = re.compile(piece_pattern()).findall
            self.unusual = re.compile(UNUSUAL).search
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)   # a token's letters stand for its bytes
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces, many by one call: behind one another with a space or line feed before each, they
        part as they did in their texts, and the tokens' lengths tell whose the ids are."""
        spaced = [x for x in new if x[0] == " " and x[1:2].strip()]
        bare = [x for x in new if x[0].strip()]
        alone = [x for x in new if not x[:2].strip()]
        size, found = self.dtype.itemsize, {}
        for pieces, gap in ((spaced, ""), (bare, "\n")):
            groups = [pieces[i: i + 256] for i in range(0, len(pieces), 256)]
            texts = [gap + gap.join(g) for g in groups]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                reached = np.cumsum(self.bytes_of[ids])
                length = np.array([len(x.encode()) for x in group]) + len(gap)
                ends = np.cumsum(length)
                stop = np.searchsorted(reached, ends)
                start = np.searchsorted(reached, ends - length + len(gap), "right")
                if not np.array_equal(reached[np.minimum(stop, len(reached) - 1)], ends):
                    alone += group      # a piece did not part as expected
                    continue
                raw = ids.tobytes()
                found.update(zip(group, [raw[a:b] for a, b in zip((start * size).tolist(), ((stop + 1) * size).tolist())]))
        found.update(zip(alone, self._whole(alone)))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: its pieces are numbered, and one step takes the numbers to ids for all texts."""
        plain = [self.by_piece and not self.unusual(t) and not any(s in t for s in self.special) for t in texts]
        whole = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        split = [self.pieces(t) if p else [] for t, p in zip(texts, plain)]
        which = np.fromiter(map(self._number.__getitem__, chain.from_iterable(split)), np.int64)
        fresh = len(self._number) - len(self._size)
        if fresh:
            new = list(islice(reversed(self._number), fresh))[::-1]
            learned = self._learn(new)
            raw = [learned[x] for x in new]
            self._ids = np.concatenate((self._ids, np.frombuffer(b"".join(raw), self.dtype)))
            self._size = np.concatenate((self._size, np.fromiter(map(len, raw), np.int64, fresh) // self.dtype.itemsize))
        ends = np.cumsum(self._size)
        size = self._size[which]
        reached = np.cumsum(size)
        ids = self._ids[np.repeat(ends[which] - reached, size) + np.arange(reached[-1] if len(reached) else 0)]
        lengths = np.concatenate(([0], reached))[list(accumulate(map(len, split), initial=0))] * self.dtype.itemsize
        joined = ids.tobytes()
        if len(self._size) > CACHE_PIECES:      # frequent pieces come early and stay; later ones served this call
            for x in list(islice(reversed(self._number), len(self._size) - CACHE_PIECES)):
                del self._number[x]
            self._ids, self._size = self._ids[: ends[CACHE_PIECES - 1] if CACHE_PIECES else 0], self._size[:CACHE_PIECES]
        return [joined[a:b] if p else next(whole) for p, (a, b) in zip(plain, pairwise(lengths.tolist()))]


def shared_encoder(path: str) -> Encoder:
    """One encoder per worker process. Functions travel by value, so what outlives a task is in a module of the process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # the tasks are the parallelism
    made = sys.modules.setdefault("wattshift_encoders", ModuleType("wattshift_encoders")).__dict__
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each key has a slot in 0..n-1 of its own."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> None:
        self.bits, self.sizes, self.rest = bits, sizes.tolist(), rest
        self.base = np.cumsum([0, *self.sizes]).tolist()
        counts = np.bitwise_count(bits)
        self.rank = np.cumsum(counts) - counts.astype(np.int64)
        self.placed = int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words = keys.view(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-max(64, int(SPREAD * len(left))) // 64) * 64
            at = _place(left, level, size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            words.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            left = left[count[at] != 1]
        return cls(np.concatenate(words or [np.zeros(0, np.uint64)]), np.array(sizes, np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of an unknown key any slot or -1."""
        keys = keys.view(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _place(keys[open_], level, size) + self.base[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.rank[at[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.placed + at[same]
        return out


class Index:
    """A shard's index: key to rows of the payload."""

    def __init__(self, header: dict, arrays: dict[str, np.ndarray]) -> None:
        self.header, self.arrays = header, arrays
        self.hash = PerfectHash(arrays["bits"], arrays["sizes"], arrays["rest"])

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, row_start: np.ndarray, dtype: str) -> Index:
        """keys: of the rows behind the first ``nulls`` rows, sorted; row_start: one more than rows."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        h = PerfectHash.build(distinct)
        slot = h.slots(distinct)
        arrays = {"bits": h.bits, "sizes": np.array(h.sizes, np.int64), "rest": h.rest, "row_start": row_start}
        for name, values, kind in (("fingerprint", fingerprints(distinct.view(np.uint64)), np.uint32),
                                   ("first_row", first + nulls, np.int64), ("rows", count, np.int64)):
            arrays[name] = np.zeros(len(distinct), kind)
            arrays[name][slot] = values
        return cls({"nulls": nulls, "dtype": dtype}, arrays)

    def to_bytes(self) -> bytes:
        parts = {k: np.ascontiguousarray(v) for k, v in self.arrays.items()}
        head = json.dumps(self.header | {"arrays": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}).encode()
        head += b" " * (-(len(MAGIC) + 8 + len(head)) % 8)
        return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *[v.tobytes() for v in parts.values()]])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index file")
        at = len(MAGIC) + 8
        size = int.from_bytes(raw[len(MAGIC): at], "little")
        header, at, arrays = json.loads(raw[at: at + size]), at + size, {}
        for name, kind, n in header.pop("arrays"):
            arrays[name] = np.frombuffer(raw, kind, n, at)
            at += arrays[name].nbytes
        return cls(header, arrays)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of every key; 0 rows for a key that the fingerprint rejects."""
        slot = self.hash.slots(keys)
        first, rows = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = slot >= 0
        known[known] = self.arrays["fingerprint"][slot[known]] == fingerprints(keys[known].view(np.uint64))
        first[known], rows[known] = self.arrays["first_row"][slot[known]], self.arrays["rows"][slot[known]]
        return first, rows


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_shard(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, out, nulls, encoder = [], [], None, 0, None
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        fs, base = _open(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out, encoder = fs.open_output_stream(f"{base}/ids-{name}.bin"), shared_encoder(tokenizer)
                end = np.array([END_ID], encoder.dtype).tobytes()
            nulls += batch.column(0).null_count
            keys.append(batch.column(0).drop_null().to_numpy())
            for start in range(0, batch.num_rows, 500):
                for ids in encoder.encode([t or "" for t in batch.column(1)[start: start + 500].to_pylist()]):
                    out.write(ids + end)
                    lengths.append(len(ids) // encoder.dtype.itemsize + 1)
        if out is None:
            return
        out.close()
        keys = np.concatenate(keys)
        row_start = np.concatenate(([0], np.cumsum(lengths)))
        with fs.open_output_stream(f"{base}/index-{name}.mph") as index:
            index.write(Index.build(keys, nulls, row_start, encoder.dtype.str).to_bytes())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": [name],
            "low": pa.array([int(keys[0]) if len(keys) else None], pa.int64()), "nulls": pa.array([nulls], pa.int64()),
            "rows": pa.array([len(lengths)], pa.int64()), "ids": pa.array([int(row_start[-1])], pa.int64())})
    return run


def write(docs: DataFrame, folder: str, tokenizer: str, shards: int | None = None) -> DataFrame:
    """Write docs (doc_id long, text) below folder; one manifest row per shard: shard, name, low, nulls, rows, ids."""
    n = shards or partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInArrow(_write_shard(folder, tokenizer),
                                     "shard long, name string, low long, nulls long, rows long, ids long"))


def _route(lows: np.ndarray, null_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            at = np.searchsorted(lows, keys.fill_null(0).to_numpy(), "right") - 1
            at[keys.is_null().to_numpy(zero_copy_only=False)] = null_shard
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.maximum(at, 0), pa.int64())], ["doc_id", "at"])
    return run


def _read(folder: str, names: list[str], before: list[int], payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        at, index, data = -1, None, None
        for batch in batches:
            shard = batch.column(1).to_numpy()
            for a, b in zip(e := np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))[:-1].tolist(), [*e[1:], len(shard)]):
                if b <= a:
                    continue
                if shard[a] != at:
                    at = int(shard[a])
                    with fs.open_input_stream(f"{base}/index-{names[at]}.mph") as f:
                        index = Index.from_bytes(f.read())
                    data = fs.open_input_file(f"{base}/ids-{names[at]}.bin")
                    start, kind = index.arrays["row_start"], np.dtype(index.header["dtype"])
                keys = batch.column(0).slice(a, b - a)
                null = keys.is_null().to_numpy(zero_copy_only=False)
                first, rows = index.find(keys.fill_null(0).to_numpy())
                first[null], rows[null] = 0, index.header["nulls"]
                out = [[], [], [], [], []]
                for key, f0, n in zip(keys.to_pylist(), first.tolist(), rows.tolist()):
                    for row in range(f0, f0 + n):
                        s, size = int(start[row]), int(start[row + 1] - start[row])
                        ids = np.frombuffer(data.read_at(size * kind.itemsize, s * kind.itemsize), kind).astype("<u4")
                        for o, v in zip(out, (key, s + before[at], size, zlib.crc32(ids), ids.tobytes() if payload else None)):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([
                    *[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return run


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Rows stored under the keys (one column, distinct): doc_id, start, n_tokens, ids_crc32, ids (4-byte integers).

    Keys go to their shard by the shards' lower bounds; unknown keys have no row.
    """
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])   # one row per shard file
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not shards:
        return keys.sparkSession.createDataFrame([], schema)
    floor = -(1 << 63)
    lows = np.array([floor if r["low"] is None else r["low"] for r in shards], np.int64)
    null_shard = next((i for i, r in enumerate(shards) if r["nulls"]), 0)
    before = np.cumsum([0, *[r["ids"] for r in shards]]).tolist()
    routed = keys.mapInArrow(_route(lows, null_shard), "doc_id long, at long")
    spread = routed.repartition(partitions(keys.sparkSession), "at").sortWithinPartitions("at", "doc_id")
    return spread.mapInArrow(_read(folder, [r["name"] for r in shards], before, payload), schema)


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, shards: int | None = None) -> DataFrame:
    """Write docs to a new store and read every document back through the index."""
    folder = scratch_path(spark, "token-ids")
    manifest = write(docs, folder, tokenizer, shards)
    return lookup(docs.select("doc_id").distinct(), manifest, folder, payload=False).drop("ids")
