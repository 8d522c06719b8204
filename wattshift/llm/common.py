"""Shared small helpers: table access, materialisation, flat text buffers for vectorised tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.session import settle

__all__ = ["documents", "table", "settle", "partitions", "row_key", "boxed", "let", "chunks", "flat_text", "words_of",
           "mix", "powers", "prefix_hash", "byte_set", "spaces"]

CHUNK_BYTES = 1 << 20   # text handled by one vectorised step; a longer document is a step of its own
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))   # A-Z to a-z, all other bytes as they are
BASE = 0x9E3779B97F4A7C15   # odd multiplier of the polynomial hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns, never null, that tell rows apart where ids may be null or repeat: the id and a hash of the text."""
    return [F.coalesce(F.col(doc_id), F.lit(0)).alias("k_id"), F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("k_text")]


def boxed(docs: DataFrame) -> DataFrame:
    """(row, k_id, k_text): the whole row as one struct beside its keys, so that no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row; a plain column may be copied into lambdas by the optimiser."""
    return F.element_at(F.transform(F.array(value), body), 1)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values behind one another and the n+1 offsets; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return data[ends[0]: ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about CHUNK_BYTES of text each, with their flat text."""
    data, ends = flat_text(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK_BYTES, "right")) - 1)
        yield batch.slice(start, stop - start), data[ends[start]: ends[stop]], ends[start: stop + 1] - ends[start]
        start = stop


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, kept between chunks and grown when a text is longer."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, powers(0), powers(0)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * CHUNK_BYTES)
            self.up, self.down = powers(self.n), powers(self.n, pow(BASE, -1, 1 << 64))
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray, tables: Powers) -> np.ndarray:
    """H with H[i] = sum of (byte + 1) * base^position over the bytes before i, modulo 2^64."""
    up, _ = tables.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def words_of(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray, tables: Powers):
    """Maximal runs of bytes that are no breaks and cross no document end.

    breaks: 256 booleans. Returns (hash, start, stop, document) of every word, in order.
    """
    word = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begin = word & (np.concatenate(([True], ~word[:-1])) | edge[:-1])
    finish = word & (np.concatenate((~word[1:], [True])) | edge[1:])
    start, stop = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    h = prefix_hash(data, tables)
    _, down = tables.get(len(data) + 1)
    return mix((h[stop] - h[start]) * down[start]), start, stop, np.searchsorted(ends, start, "right") - 1


def byte_set(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern)] = True
    return out


def spaces() -> np.ndarray:
    """The ASCII white space that parts words: space and 09 to 0D."""
    return byte_set(b" \t\n\x0b\x0c\r")
