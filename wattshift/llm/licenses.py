"""Licence texts by a positional index of rare words.

Templates are short licence texts, each with key phrases of two to five words of which a stated number must be there. How rare a
licence word is comes from the whole corpus (documents that hold it); its weight is that rarity, plus a little for words that every
document holds. Each template is posted under its rarest words, which make up at least ``RARE`` of its weight, with their places.

For a document, the postings of its licence words, from the rarest word on, name templates. The places of a template's rare words in the
document give the place at which the template would start; starts that differ by at most ``DRIFT`` words count together, so that a
template with some inserted, lost or changed words is still found. The weight of the distinct template places that meet at a start, over
that of all posted places, is the aligned share. From ``SHARE`` on, the key phrases are verified in the words that the template spans there, and its label
holds. The score is the largest aligned share of a template that holds.

Besides, the places of fixed base phrases are counted; their labels always hold, with score 1.

Words are runs of letters and digits (ASCII lower-cased) and of characters beyond ASCII.

Defined cases: null and empty text has no word, no label and score 0; repeated rows are scanned each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import LOWER

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

SHARE = 0.7     # least aligned share
RARE = 0.8      # share of a template's weight that its posted words make up
DRIFT = 4       # words by which the starts of one alignment may differ
FLOOR = 0.1     # weight of a word that every document holds
UNIT = 1 << 20

# Fixed values: (label, key phrases that must be there, key phrases, template) of public licence notices, as words.
TEMPLATES = (
    ("mit", 1, ("mit license",), "released under the mit license"),
    ("mit", 1, ("mit license",), "distributed under the terms of the mit license"),
    ("mit", 1, ("license identifier mit",), "spdx license identifier mit"),
    ("mit", 2, ("free of charge to any", "deal in the software without", "sublicense and or sell copies"),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software"),
    ("apache-2", 1, ("apache license version 2",), "licensed under the apache license version 2 0"),
    ("apache-2", 1, ("identifier apache 2 0",), "spdx license identifier apache 2 0"),
    ("apache-2", 2, ("use this file except in", "compliance with the license", "obtain a copy of the"),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
     "a copy of the license at"),
    ("bsd", 1, ("license identifier bsd",), "spdx license identifier bsd"),
    ("bsd", 2, ("source and binary forms", "with or without modification", "following conditions are met"),
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", 2, ("gnu general public license", "public license version 3"), "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", 1, ("license identifier gpl 3 0",), "spdx license identifier gpl 3 0"),
    ("gpl-2", 2, ("gnu general public license", "public license version 2"), "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", 1, ("license identifier gpl 2 0",), "spdx license identifier gpl 2 0"),
    ("gpl", 2, ("gnu general public license", "redistribute it and or modify"), "this program is free software you can redistribute it and or modify it "
     "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", 1, ("gnu lesser general public license",), "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", 1, ("gnu affero general public license",), "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", 1, ("mozilla public license v 2",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 1, ("identifier mpl 2 0",), "spdx license identifier mpl 2 0"),
    ("cc-by-nc", 1, ("cc by nc",), "licensed under cc by nc 4 0"),
    ("cc-by-nc", 1, ("creative commons attribution noncommercial",), "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", 1, ("cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by-sa", 1, ("creative commons attribution sharealike",), "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", 1, ("creative commons attribution 4 0",), "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", 1, ("cc0 1 0 universal",), "this work is dedicated to the public domain under cc0 1 0 universal"),
    ("isc", 2, ("copy modify and or distribute", "with or without fee", "above copyright notice and this"),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", 1, ("free and unencumbered software",), "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", 1, ("all rights reserved",), "all rights reserved"),
)

_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def vocabulary() -> list[str]:
    return sorted({w for *_, t in TEMPLATES for w in t.split()})


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents that hold each licence word, and under '' all documents. Tasks send one row per word at most."""
    words = frozenset(w.encode() for w in vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = dict.fromkeys(words, 0), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in words.intersection(split_words(text)):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": ["", *[w.decode() for w in found]], "n": pa.array([n, *found.values()], pa.int64())})

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}     # one row per word of the templates


class Template(NamedTuple):
    label: str
    need: int
    keys: list[list[bytes]]
    words: list[bytes]
    posted: list[tuple[bytes, int]]     # rare words and their places
    weights: np.ndarray                 # by place, 0 where not posted
    least: int                          # aligned weight that the share asks for


def _phrase(words: list[bytes], phrase: list[bytes], start: int, stop: int) -> bool:
    """Does the phrase stand inside words[start:stop]?"""
    part = words[start:stop]
    return any(part[i: i + len(phrase)] == phrase for i, w in enumerate(part) if w == phrase[0])


class Index:
    """Templates under their rare words."""

    def __init__(self, frequency: dict[str, int]) -> None:
        n = frequency.get("", 0)
        rarity = {w.encode(): math.log((n + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary()}
        self.weight = {w: round((FLOOR + r) * UNIT) for w, r in rarity.items()}     # whole numbers add up exactly in any order
        self.templates: list[Template] = []
        self.postings: dict[bytes, set[int]] = {}
        for label, need, keys, text in TEMPLATES:
            words, phrases = text.encode().split(), [k.encode().split() for k in keys]
            if not all(_phrase(words, p, 0, len(words)) for p in phrases):
                raise ValueError(f"a template of {label} lacks a key phrase")
            ranked = sorted(range(len(words)), key=lambda j: (-self.weight[words[j]], j))
            total, covered, weights, posted = sum(self.weight[w] for w in words), 0, np.zeros(len(words), np.int64), []
            for j in ranked:
                if covered >= RARE * total:
                    break
                weights[j] = self.weight[words[j]]
                covered += weights[j]
                posted.append((words[j], j))
            for w, _ in posted:
                self.postings.setdefault(w, set()).add(len(self.templates))
            self.templates.append(Template(label, need, phrases, words, posted, weights, math.ceil(SHARE * int(weights.sum()))))
        self.words = frozenset(self.postings)

    def named(self, present: set[bytes]) -> list[int]:
        """Templates that the document's licence words name, those of the rarest word first, if enough of their words and keys are there."""
        seen: dict[int, None] = {}
        for w in sorted(self.words & present, key=lambda w: (-self.weight[w], w)):
            seen.update(dict.fromkeys(sorted(self.postings[w])))
        return [k for k in seen if (t := self.templates[k]) and sum(t.weights[j] for w, j in t.posted if w in present) >= t.least
                and sum(present.issuperset(key) for key in t.keys) >= t.need]

    def scan(self, words: list[bytes], present: set[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that hold, and the largest aligned share among them."""
        labels, best = set(), 0.0
        named = self.named(present)
        if not named:
            return labels, best
        wanted = {w for k in named for w, _ in self.templates[k].posted}
        places: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        found = {w: np.array(p, np.int64) for w, p in places.items()}
        for k in named:
            share = self._align(self.templates[k], words, found)
            if share:
                labels.add(self.templates[k].label)
                best = max(best, share)
        return labels, best

    def _align(self, t: Template, words: list[bytes], found: dict[bytes, np.ndarray]) -> float:
        """Largest aligned share at a start where the key phrases are there too, 0 if there is none."""
        start = np.concatenate([found[w] - j for w, j in t.posted])
        place = np.repeat(np.array([j for _, j in t.posted]), [len(found[w]) for w, _ in t.posted])
        order = np.argsort(start, kind="stable")
        start, place = start[order], place[order]
        # Runs of starts whose neighbours are at most DRIFT apart; only runs of enough weight are walked through.
        edges = np.concatenate(([0], np.flatnonzero(np.diff(start) > DRIFT) + 1, [len(start)]))
        heavy = np.add.reduceat(t.weights[place], edges[:-1]) >= t.least if len(start) else []
        best = 0.0
        for r in np.flatnonzero(heavy):
            best = max(best, self._walk(t, words, start[edges[r]: edges[r + 1]].tolist(), place[edges[r]: edges[r + 1]].tolist()))
        return best

    @staticmethod
    def _walk(t: Template, words: list[bytes], start: list[int], place: list[int]) -> float:
        """Slide a window of DRIFT over sorted starts, with the weight of the distinct places inside."""
        held, weight, first, best = [0] * len(t.words), 0, 0, 0
        weights = t.weights.tolist()
        for i, s in enumerate(start):
            if not held[place[i]]:
                weight += weights[place[i]]
            held[place[i]] += 1
            while start[first] < s - DRIFT:
                held[place[first]] -= 1
                if not held[place[first]]:
                    weight -= weights[place[first]]
                first += 1
            if weight >= t.least and weight > best:
                a, b = max(0, start[first]), s + len(t.words)
                if sum(_phrase(words, key, a, b) for key in t.keys) >= t.need:
                    best = weight
        return best / sum(weights)


def _base_places(words: list[bytes], present: set[bytes]) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    for phrase, label in BASE:
        parts = phrase.encode().split()
        if present.issuperset(parts):
            joined, step = b" " + b" ".join(words) + b" ", b" " + b" ".join(parts) + b" "
            starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            at = joined.find(step)
            while at >= 0:
                places.append(int(np.searchsorted(starts, at)))
                labels.add(label)
                at = joined.find(step, at + 1)
    return places, labels


def _scan(index: Index):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(text)
                present = set(words)
                places, base = _base_places(words, present)
                labels, score = index.scan(words, present)
                out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
                            ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [()] * 8, kinds)], list(columns))
    return run


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, base places and labels, all labels, score."""
    index = Index(document_frequencies(docs))
    return docs.select("doc_id", "text").mapInArrow(
        _scan(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
