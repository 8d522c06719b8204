"""Small document tables with every awkward case, and plain statements of the operators."""

from __future__ import annotations

import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, k_id long, k_text string, size long, node long, tile long, "
          "`row` string, component long, route long, at long, kind int, ranges string, score double, page string, host string, digest string, "
          "stratum string, n_words long, kept boolean, set_key string, t string, h string, w long, slots string, n_items long, item_ids string, "
          "n_lines long, n_dropped long, gone string, label string, words long, piece long, grp long, cluster string")
WIDTH = 38
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); all other columns hold nulls or clash."""
    full = [(i, t, la, so, None if t is None else len(t), 7, "x", 1, 2, 3, "r", 4, 5, 6, 7, "z", 0.5, "p", "h", "d", "s", 8, True)
            for i, t, la, so in rows]
    return spark.createDataFrame([(*r, *[None] * (WIDTH - len(r))) for r in full], SCHEMA)


def table_rows(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def awkward(start: int = 900_000):
    """Null ids and texts, empty and blank texts, one very long text, ties, repeated rows, one id with two texts."""
    base = " ".join(f"word{i % 97}x{i * 7 % 31}" for i in range(120))
    near = base.replace("word5x4", "other")
    return [
        (start, None, "en", "src0"), (start + 1, "", None, None), (start + 2, " \n\t \n", "en", "src0"),
        (start + 3, base, "en", "src1"), (start + 4, base, "en", "src1"), (start + 5, near, "de", None),
        (start + 6, base.upper(), None, "src1"), (start + 7, "one two", "en", "src0"), (start + 8, "one two", "en", "src0"),
        (start + 9, (base + "\n") * 300, "en", "src2"), (start + 9, (base + "\n") * 300, "en", "src2"),
        (start + 10, "a b c d e f g h", "en", "src0"), (start + 10, near + " tail", "en", "src0"),
        (None, base + " end", "en", "src0"), (None, None, None, None), (None, "one two", "en", None),
        (start + 11, "é" * 150 + " ßüß 数字   x", "fr", "src3"), (start + 12, "a" * 400, "en", "src3"), (-5, "tie tie tie", "en", "src3"),
    ]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    w = words((text or "").translate(A_TO_Z))
    if len(w) >= width:
        return frozenset(tuple(w[i: i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_groups(rows, width, percent=80):
    """id -> smallest id reachable; an inverted index of shingles gives all overlaps."""
    groups = Groups({r[0] for r in rows if r[0] is not None})
    texts = {(r[0], shingles(r[1], width)) for r in rows if r[0] is not None}
    held: dict = {}
    for i, s in texts:
        counts: dict = {}
        for g in s:
            for other in held.setdefault(g, []):
                counts[other] = counts.get(other, 0) + 1
            held[g].append((i, s))
        for (j, o), n in counts.items():
            if 100 * n >= percent * (len(s) + len(o) - n):
                groups.join(i, j)
    return {i: groups.find(i) for i in groups.up}
