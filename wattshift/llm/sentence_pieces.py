"""SentencePiece ids of documents and back, with a table of distinct chunks.

Where no piece of the model crosses a whitespace marker, a text's ids are the ids of its marked words (a run of markers and what
follows up to the next one; a line feed that no piece holds also opens a chunk) behind one another. So each distinct chunk is segmented once:

1. Documents are read in blocks of about ``BLOCK_BYTES`` of text. A block numbers its distinct chunks, frequent ones first; a document becomes
   the numbers of its chunks, in order. The distinct chunks are dealt into buckets by hash. Both go to a table bucketed by block.
2. The chunks of all blocks meet bucket by bucket; the library segments every different one once.
3. The ids go back to their blocks and take the places of the numbers. Documents do not move: their blocks are where the ids arrive.

A chunk occurs once a block however frequent it is, so no chunk is hot; a block and the distinct chunks of a bucket bound what one task holds.
What moves or is stored is compressed per block and bucket. Decoding is the library's, on each document's ids. The driver loads the model to
see whether its pieces and its normalisation allow the cut; if not, texts are encoded whole.

Defined cases: null and empty texts have only the begin and end ids and decode to an empty text; literal marker characters count as spaces, as in
the library; very long texts are a block of their own; repeated rows are encoded each; an empty table has no rows; only the text and
the carried columns are read, others may have any name.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from wattshift.llm.common import partitions
from wattshift.session import scratch_path

BLOCK_BYTES = 16 << 20     # characters of text whose chunks are numbered together
SLICE_ROWS = 256
MARK = "▁"
BLOCK_FIELDS = [StructField("block", LongType()), StructField("bucket", IntegerType()), StructField("texts", BinaryType()), StructField("at", BinaryType())]
PLANES = ["b0", "b1", "b2", "b3"]   # the bytes of a document's chunk numbers, which compress better apart


class Model:
    """A model file, and whether and where its texts may be cut."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        size = self.processor.vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.mark = self.processor.piece_to_id(MARK)

    def cuts(self) -> str | None:
        """Characters that open a chunk, or None where texts must stay whole."""
        p = self.processor
        pieces = [p.id_to_piece(i) for i in range(p.vocab_size())]
        every = "".join(chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF)
        # Any text is marked in front and at its spaces, and is otherwise left as it is.
        plain = all(p.normalize(t) == MARK + t.replace(" ", MARK) for t in (every, " a  b ", "\n a \n"))
        if not plain or p.is_unknown(self.mark) or any(MARK in x.lstrip(MARK) for x in pieces):
            return None
        feed = p.encode("\n")
        alone = len(feed) == 2 and feed[0] == self.mark and p.is_byte(feed[1]) and not any("\n" in x for x in pieces)
        return " \n" if alone else " "

    def chunks(self, texts: list[str]) -> list[list[int]]:
        """Ids of chunks; the library puts a marker in front, which takes the place of the chunk's first space or is dropped."""
        found = self.processor.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [ids[1:] if t[0] != " " else ids or [self.mark] for t, ids in zip(texts, found)]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, "<u4").reshape(-1, 1).view(np.uint8).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_texts(texts: list[str]) -> bytes:
    """Lengths and characters of texts."""
    lengths = _pack(np.fromiter(map(len, texts), "<u4", len(texts)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress("".join(texts).encode())


def _unpack_texts(raw: bytes) -> list[str]:
    at = 4 + int.from_bytes(raw[:4], "little")
    joined = zstandard.decompress(raw[at:]).decode()
    return [joined[a:b] for a, b in pairwise(accumulate(_unpack(raw[4:at]).tolist(), initial=0))]


def _cut(opens: str, buckets: int):
    rest = f"[^{re.escape(opens)}]*"
    others = "".join(c for c in opens if c != " ")
    find = re.compile(f" +{rest}" + (f"|[{re.escape(others)}]{rest}" if others else "")).findall

    def numbering() -> defaultdict:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        return number

    def settled(block: int, number: dict, rows: list[pa.Array], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The documents of a block by their chunks' numbers, and the chunks by bucket with their numbers."""
        uses = np.bincount(np.concatenate(docs) if docs else [], minlength=len(number))
        rank = np.empty(len(number), "<u4")
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(number), dtype="<u4")
        for column in rows:
            own, docs = docs[: len(column)], docs[len(column):]
            planes = [np.ascontiguousarray(rank[x]).view(np.uint8).reshape(-1, 4) for x in own]
            yield batch_of(block, len(column), column, {f"b{k}": pa.array([x[:, k].tobytes() for x in planes], pa.binary()) for k in range(4)})
        dealt: list[list[str]] = [[] for _ in range(buckets)]
        for chunk in sorted(number):
            dealt[zlib.crc32(chunk.encode()) % buckets].append(chunk)
        held = [k for k in range(buckets) if dealt[k]]
        for at in range(0, len(held), 64):
            part = held[at: at + 64]
            places = [rank[np.fromiter(map(number.__getitem__, dealt[k]), np.int64, len(dealt[k]))] for k in part]
            yield batch_of(block, len(part), pa.nulls(len(part), rows[0].type), {
                "bucket": pa.array(part, pa.int32()), "texts": pa.array([_pack_texts(dealt[k]) for k in part], pa.binary()),
                "at": pa.array([_pack(x) for x in places], pa.binary())})

    def batch_of(block: int, n: int, row: pa.Array, given: dict) -> pa.RecordBatch:
        columns = {"block": pa.array([block] * n, pa.int64()), "bucket": pa.nulls(n, pa.int32()), "row": row} | given
        names = [f.name for f in BLOCK_FIELDS] + PLANES + ["row"]
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, pa.binary())) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, number, rows, docs = TaskContext.get().partitionId() << 32, 0, numbering(), [], []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows.append(part.column(0))
                for text in part.column(1).to_pylist():
                    found = find(" " + text.replace(MARK, " ")) if text else []
                    docs.append(np.fromiter(map(number.__getitem__, found), "<u4", len(found)))
                    size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield from settled(block, number, rows, docs)
                    block, size, number, rows, docs = block + 1, 0, numbering(), [], []
        if rows:
            yield from settled(block, number, rows, docs)
    return run


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces of flat that ``which`` names, behind one another."""
    size = sizes[which]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _segment(path: str):
    """The chunks of every block, bucket by bucket, to their numbers of ids and their ids, in the same order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = None, None
        for batch in batches:
            model = model or Model(path)
            out = []
            for block, bucket, raw in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != at:
                    at, known = bucket, {}      # every chunk of the bucket that has come up, and its ids
                texts = _unpack_texts(raw)
                new = [t for t in texts if t not in known]
                known.update(zip(new, [np.array(ids, model.dtype).tobytes() for ids in model.chunks(new)]))
                found = [known[t] for t in texts]
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // model.dtype.itemsize
                out.append((block, bucket, _pack(sizes), zstandard.compress(b"".join(found))))
            block, bucket, sizes, ids = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
                                             ["block", "bucket", "sizes", "ids"])
    return run


def _place(path: str, decoded: bool):
    """The documents of a block as numbers, the numbers of its chunks by bucket, and the ids of the chunks: documents as ids."""
    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        model = Model(path)
        numbers_of = {k: _unpack(x) for k, x in zip(held["bucket"].to_pylist(), held["at"].to_pylist()) if k is not None}
        which = np.concatenate([numbers_of[k] for k in found["bucket"].to_pylist()] or [np.zeros(0, "<u4")])
        size = np.concatenate([_unpack(x) for x in found["sizes"].to_pylist()] or [np.zeros(0)]).astype(np.int64)
        begin, end = model.processor.bos_id(), model.processor.eos_id()
        flat = np.frombuffer(b"".join([*map(zstandard.decompress, found["ids"].to_pylist()), np.array([begin, end], model.dtype).tobytes()]), model.dtype)
        starts, sizes = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        starts[which], sizes[which] = np.cumsum(size) - size, size
        docs = held.filter(pa.compute.is_valid(held["b0"]))
        counts, out, texts = [], [], []
        for part in docs.to_batches(max_chunksize=SLICE_ROWS):
            listed = []
            for planes in zip(*[part.column(c).to_pylist() for c in PLANES]):
                number = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1).reshape(-1).view("<u4")
                ids = np.concatenate(([begin], _gather(flat, starts, sizes, number), [end])).astype("<u4")
                counts.append(len(ids))
                out.append(ids.tobytes())
                listed.append(ids.tolist() if decoded else None)
            texts += model.processor.decode(listed) if decoded else []
        columns = {"row": docs["row"], "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(out, pa.binary())}
        return pa.table(columns | ({"text": pa.array(texts, pa.string())} if decoded else {}))
    return run


def _whole(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Model(path)
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = model.processor.encode([t or "" for t in part.column(1).to_pylist()], add_bos=True, add_eos=True, num_threads=1)
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(model.processor.decode(ids), pa.string())] if decoded else []),
                                                 ["row", "n_tokens", "ids"] + ["text"] * decoded)
    return run


def _settled_blocks(rows: DataFrame, opens: str) -> DataFrame:
    """Documents and distinct chunks by block, in a table bucketed by block."""
    spark = rows.sparkSession
    schema = StructType([*BLOCK_FIELDS, *[StructField(c, BinaryType()) for c in PLANES], StructField("row", rows.schema["row"].dataType)])
    name = f"wattshift_blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(_cut(opens, partitions(spark)), schema).write.bucketBy(partitions(spark), "block").option(
        "path", scratch_path(spark, "blocks")).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, model: str, text: str = "text", carry: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The carried columns, n_tokens and ids (little-endian 4-byte integers, begin and end ids included) of every row.

    ``model`` is a path that the driver and all executors can open. ``decoded`` adds the text that the library makes of the ids.
    """
    opens = Model(model).cuts()
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType([rows.schema["row"], StructField("n_tokens", LongType()), StructField("ids", BinaryType()), *[StructField("text", StringType())] * decoded])
    if opens is None:
        encoded = rows.mapInArrow(_whole(model, decoded), schema)
    else:
        blocks = _settled_blocks(rows, opens)
        chunks = blocks.filter("bucket is not null").select("block", "bucket", "texts")
        met = chunks.repartitionById(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
        found = met.mapInArrow(_segment(model), "block long, bucket int, sizes binary, ids binary")
        held = blocks.select("block", "bucket", "at", *PLANES, "row")
        encoded = held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_place(model, decoded), schema)
    return encoded.select(*[F.col("row").getField(c).alias(c) for c in carry], "n_tokens", "ids", *["text"] * decoded)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns, and the library's text of the ids in a new column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in batches:
            loaded = loaded or Model(model)
            at = batch.schema.get_field_index(ids)
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column(at).to_pylist()]
                yield part.append_column(text, pa.array(loaded.processor.decode(values) if values else [], pa.string()))
    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField(text, StringType())]))
