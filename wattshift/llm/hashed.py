"""Hashed text features and the choice of training rows, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import LOWER, Powers, byte_set, mix, spaces, words_of

BITS = 20
PUNCTUATION = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind * 0x2545F4914F6CDD1D % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def word_grams(data: np.ndarray, ends: np.ndarray, tables: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every word, pair of neighbours, and pair with one word between (skip-gram), unsorted."""
    lower = np.frombuffer(LOWER, np.uint8)[data]
    h, _, _, doc = words_of(lower, ends, byte_set(PUNCTUATION), tables)
    docs, slots = [doc], [_slots(h, 1)]
    for gap, kind in ((1, 2), (2, 3)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        pair = h[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + h[gap:][same] if len(same) else h[:0]
        docs.append(doc[:-gap][same] if len(same) else doc[:0])
        slots.append(_slots(pair, kind))
    return np.concatenate(docs), np.concatenate(slots)


def _classes() -> np.ndarray:
    """Byte classes for word shapes: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, others themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 4
    out[spaces()] = 0
    out[[b for b in range(5, 32) if not spaces()[b]]] = 5
    out[1:5] = np.where(np.arange(1, 5) < 5, 5, 0)
    return out


def style(data: np.ndarray, ends: np.ndarray, tables: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of words, word shapes (runs of one class count once), shape pairs, and words that repeat the one before."""
    lower = np.frombuffer(LOWER, np.uint8)[data]
    h, _, _, doc = words_of(lower, ends, spaces(), tables)
    kinds = _classes()[data]
    turn = np.concatenate(([True], kinds[1:] != kinds[:-1])) if len(kinds) else np.zeros(0, bool)
    turn[ends[:-1][ends[:-1] < len(kinds)]] = True
    zero = np.zeros(256, bool)
    zero[0] = True
    shape, _, _, shape_doc = words_of(kinds[turn], np.concatenate(([0], np.cumsum(turn)))[ends], zero, tables)
    docs, slots = [doc, shape_doc], [_slots(h, 4), _slots(shape, 5)]
    if len(doc) > 1:
        same = doc[1:] == doc[:-1]
        docs += [doc[1:][same], doc[1:][same & (h[1:] == h[:-1])]]
        slots += [_slots(shape[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + shape[1:][same], 6),
                  _slots(np.full(len(docs[-1]), 1, np.uint64), 7)]
    return np.concatenate(docs), np.concatenate(slots)


def counted(doc: np.ndarray, slot: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of documents, then slots and counts: every slot of a document once, sorted."""
    pair, count = np.unique((doc << BITS) | slot, return_counts=True)
    return np.searchsorted(pair >> BITS, np.arange(n_docs + 1)), pair & ((1 << BITS) - 1), count


def held_out(doc_id: Column) -> Column:
    """The documents that no training sees: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_ids(labels: DataFrame, target: Column, max_rows: int) -> DataFrame:
    """(doc_id, target) of about max_rows labelled ids at most, chosen by a hash of the id, held-out ids never.

    Labels that are null do not count; an id with several takes the largest. The result is small enough to broadcast.
    """
    known = (labels.select("doc_id", target.alias("target")).filter(F.col("doc_id").isNotNull() & F.col("target").isNotNull())
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("target").alias("target")))
    share = min(1.0, max_rows / max(1, known.count()))
    bound = min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)     # of the whole 64-bit range, so no share is too small
    return known.filter(F.xxhash64("doc_id") <= bound)


def training_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(target, text) in an order that depends on ids alone, in one partition of bounded size."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("target", "text")


def weights_batch(slots: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(values, pa.float64())], ["slot", "weight"])


def collect_weights(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most 2^BITS rows; negative slots are parameters beside the weights."""
    found = weights.toArrow()
    return found.column("slot").to_numpy().astype(np.int32), found.column("weight").to_numpy().astype(np.float32)
