"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

The learner keeps two numbers per coordinate: a gradient sum shrunk by L1 and a sum of squared gradients that sets the
coordinate's own rate. L1 leaves few weights above zero, so the model is small and travels with the tasks. It is fitted on
about ``max_rows`` labelled rows by one task; scoring reads every text whole.

Defined cases: null and empty text score by the bias alone; without any label, or with labels of one kind only, every score
is the smoothed share of toxic labels (0.5 without labels); null ids are never held out; repeated rows are scored each; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import Powers, chunks
from wattshift.llm.hashed import BITS, collect_weights, counted, held_out, training_ids, training_rows, weights_batch, word_grams


@dataclass(frozen=True)
class FtrlParams:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 6
    max_rows: int = 24_000      # labelled rows used for fitting
    threshold: float = 0.7


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the bias, which has no L1."""

    def __init__(self, params: FtrlParams) -> None:
        self.p = params
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, p = self.z[at], self.p
        l1 = np.where(at == 1 << BITS, 0.0, p.l1)
        rate = (p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / rate, 0.0)

    def learn(self, slots: np.ndarray, target: int) -> None:
        at = np.append(slots, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - target
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.p.alpha * w
        self.n[at] += g * g


def _fit(params: FtrlParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model, rows = Powers(), Ftrl(params), []
        for batch in batches:
            for part, data, ends in chunks(batch):
                edges, slots, _ = counted(*word_grams(data, ends, tables), part.num_rows)
                slots = slots.astype(np.int32)
                rows += [(slots[a:b], y) for a, b, y in zip(edges[:-1], edges[1:], part.column(0).to_pylist())]
        positive = sum(y for _, y in rows)
        share = (positive + 0.5) / (len(rows) + 1)
        if 0 < positive < len(rows):
            for _ in range(params.epochs):
                for slots, y in rows:
                    model.learn(slots, y)
            every = np.arange((1 << BITS) + 1)
            w = model.weights(every)
            some = np.flatnonzero(w[:-1])
            yield weights_batch(np.append(some, -1), np.append(w[some], w[-1]))
        else:
            yield weights_batch(np.array([-1]), np.array([np.log(share / (1 - share))]))
    return run


def fit(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """(slot, weight) of the fitted model, the bias at slot -1; labels: doc_id, toxic."""
    chosen = training_ids(labels, F.col("toxic"), params.max_rows)
    return training_rows(docs, chosen).mapInArrow(_fit(params), "slot long, weight double")


def _score(slots: np.ndarray, values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, dense = Powers(), np.zeros(1 << BITS)
        dense[slots[slots >= 0]] = values[slots >= 0]
        bias = float(values[slots == -1].sum())
        for batch in batches:
            for part, data, ends in chunks(batch):
                doc, slot = word_grams(data, ends, tables)
                some = dense[slot] != 0
                edges, found, _ = counted(doc[some], slot[some], part.num_rows)
                total = np.concatenate(([0.0], np.cumsum(dense[found])))
                score = 1 / (1 + np.exp(-np.clip(total[edges[1:]] - total[edges[:-1]] + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    model = collect_weights(fit(docs, labels, params))
    scored = docs.select("doc_id", "text").mapInArrow(_score(*model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= params.threshold).cast("int").alias("predicted"))
