"""Quality grades by ordinal regression (cumulative links) on hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score: P(grade >= k) = sigmoid(score - t_k). The
likelihood of a row's grade is the difference of two neighbouring tails. Steps have per-coordinate rates (AdaGrad), thresholds
stay ordered with a least gap. The result gives the expected grade and all tail probabilities for selection.

Features are words, word shapes, shape pairs and repetitions; a document's counts are square roots scaled to length one.
The model is fitted on about ``max_rows`` labelled rows by one task; scoring reads every text whole.

Defined cases: null and empty text score by the thresholds alone; without labels all grades are equally likely; grades outside
0..grades-1 and null grades do not count; null ids are never held out; repeated rows are scored each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import Powers, chunks
from wattshift.llm.hashed import BITS, collect_weights, counted, held_out, style, training_ids, training_rows, weights_batch


@dataclass(frozen=True)
class OrdinalParams:
    grades: int = 3
    rate: float = 0.5
    l2: float = 1e-6
    epochs: int = 4
    max_rows: int = 24_000      # labelled rows used for fitting
    min_tail: float = 0.5       # a document is kept if P(grade >= 1) is at least this
    gap: float = 0.01           # least distance of neighbouring thresholds


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """Proportional-odds model: score = w.x, tails sigmoid(score - t)."""

    def __init__(self, params: OrdinalParams, shares: np.ndarray) -> None:
        self.p = params
        self.w, self.gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
        tails = np.clip(np.cumsum(shares[::-1])[::-1][1:], 0.01, 0.99)
        self.t = np.maximum.accumulate(-np.log(tails / (1 - tails)) + np.arange(len(tails)) * params.gap)
        self.gt = np.full(len(self.t), 1e-8)

    def learn(self, slots: np.ndarray, x: np.ndarray, grade: int) -> None:
        tails = np.concatenate(([1.0], sigmoid(self.w[slots] @ x - self.t), [0.0]))
        high, low = tails[grade], tails[grade + 1]
        p = max(high - low, 1e-9)
        g = -(1 - high - low) * x + self.p.l2 * self.w[slots]
        self.gw[slots] += g * g
        self.w[slots] -= self.p.rate * g / np.sqrt(self.gw[slots])
        gt = np.zeros(len(self.t))
        if grade > 0:
            gt[grade - 1] = high * (1 - high) / p
        if grade < len(self.t):
            gt[grade] = -low * (1 - low) / p
        gt = np.clip(gt, -5, 5)
        self.gt += gt * gt
        t = self.t - 0.1 * gt / np.sqrt(self.gt)
        steps = np.arange(len(t)) * self.p.gap
        self.t = np.maximum.accumulate(t - steps) + steps


def _values(count: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(count)))
    return np.sqrt(count / np.repeat(np.maximum(total[edges[1:]] - total[edges[:-1]], 1), np.diff(edges)))


def _fit(params: OrdinalParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows = Powers(), []
        for batch in batches:
            for part, data, ends in chunks(batch):
                edges, slots, count = counted(*style(data, ends, tables), part.num_rows)
                x, slots = _values(count, edges).astype(np.float32), slots.astype(np.int32)
                rows += [(slots[a:b], x[a:b], y) for a, b, y in zip(edges[:-1], edges[1:], part.column(0).to_pylist())]
        shares = (np.bincount([y for *_, y in rows], minlength=params.grades) + 0.5) / (len(rows) + 0.5 * params.grades)
        model = Ordinal(params, shares)
        for _ in range(params.epochs):
            for row in rows:
                model.learn(*row)
        some = np.flatnonzero(model.w)
        yield weights_batch(np.concatenate((some, -1 - np.arange(len(model.t)))), np.concatenate((model.w[some], model.t)))
    return run


def fit(docs: DataFrame, labels: DataFrame, grade: Column, params: OrdinalParams = OrdinalParams()) -> DataFrame:
    """(slot, weight) of the fitted model; threshold k is at slot -k. grade: an expression over labels."""
    good = F.when((grade >= 0) & (grade < params.grades), grade.cast("int"))
    return training_rows(docs, training_ids(labels, good, params.max_rows)).mapInArrow(_fit(params), "slot long, weight double")


def _score(slots: np.ndarray, values: np.ndarray, grades: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, dense = Powers(), np.zeros(1 << BITS)
        dense[slots[slots >= 0]] = values[slots >= 0]
        t = np.array([values[slots == -1 - k].sum() if (slots == -1 - k).any() else np.log((k + 1) / (grades - 1 - k)) for k in range(grades - 1)])
        for batch in batches:
            for part, data, ends in chunks(batch):
                edges, found, count = counted(*style(data, ends, tables), part.num_rows)
                total = np.concatenate(([0.0], np.cumsum(dense[found] * _values(count, edges))))
                tails = sigmoid((total[edges[1:]] - total[edges[:-1]])[:, None] - t)
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * (grades - 1), pa.array(tails.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1), pa.float64()), lists], ["doc_id", "expected_grade", "tails"])
    return run


def grade(docs: DataFrame, labels: DataFrame, rating: Column, params: OrdinalParams = OrdinalParams()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, expected_grade, tails (P(grade >= 1), ...), kept."""
    model = collect_weights(fit(docs, labels, rating, params))
    scored = docs.select("doc_id", "text").mapInArrow(_score(*model, params.grades), "doc_id long, expected_grade double, tails array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tails",
                         (F.get("tails", F.lit(0)) >= params.min_tail).alias("kept"))
