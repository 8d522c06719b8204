import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from cases import SCHEMA, awkward, frame, table_rows
from pyspark.sql import functions as F

from wattshift.llm import merkle, sentence_pieces, whitening

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- Merkle manifest ---


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row
    values = [i, source, lang, None if n is None else n + more, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i: i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof_of(levels, i, fanout):
    steps = []
    for nodes in levels[:-1]:
        low = i // fanout * fanout
        steps.append((nodes[low:i], nodes[i + 1: low + fanout]))
        i //= fanout
    return steps


def manifests(rows, fanout=2):
    """Plain statement: every row of the result, sorted."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    held = {t: sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for t in names}
    levels = {t: levels_of([leaf(r) for r in held[t]], fanout) for t in names}
    top = levels_of([levels[t][-1][0] for t in names], fanout)
    out = []
    for at, t in enumerate(names):
        for i, r in enumerate(held[t]):
            steps = proof_of(levels[t], i, fanout) + proof_of(top, at, fanout)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if hit else leaf(r)
            for before, after in steps:
                node = H(*before, node, *after)
            out.append((r[0], leaf(r), levels[t][-1][0], top[-1][0], H(*[x for b, a in steps for x in b + a]), node, node == top[-1][0]))
    return sorted(out, key=str)


def with_sizes(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def test_manifest_by_brute_force(spark):
    rows = table_rows(spark, SF) + awkward() + awkward(950_000)
    got = sorted((tuple(r) for r in merkle.verify(frame(spark, rows)).collect()), key=str)
    assert got == manifests(with_sizes(rows)) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fanout,block", [(2, 8), (3, 9), (5, 4)])
def test_other_fanouts_and_many_stages(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)
    rows = table_rows(spark, SF)[:150] + awkward()
    found = merkle.manifest(frame(spark, rows), fanout=fanout, changed=merkle.tampered()).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof"), merkle.folded(F.col("changed_leaf"), F.col("path")).alias("folded"))
    got = sorted(((*r, r["folded"] == r["root"]) for r in found.collect()), key=str)
    assert got == manifests(with_sizes(rows), fanout)


def test_manifest_of_little(spark):
    assert not merkle.verify(frame(spark, []).filter("false")).collect()
    only = [(5, None, None, None)]
    assert [tuple(r) for r in merkle.verify(frame(spark, only)).collect()] == manifests(with_sizes(only))


# --- SentencePiece ---


def library(texts):
    p = sentence_pieces.Model(MODEL).processor
    ids = [p.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    return [(len(x), np.array(x, "<u4").tobytes(), p.decode(x)) for x in ids]


def odd_texts(n=400):
    rng = random.Random(7)
    letters = list("  \n\n\t\r▁▁abcdeABC019.,<s>#éßñ数字日 ​ \x00\x7f") + ["🙂", "é", "the ", "of ", "\U0010ffff", "﻿"]
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 8, 40, 200]))) for _ in range(n)]


def decoded(docs):
    """Ids and texts, the texts by either way."""
    both = sentence_pieces.decode(sentence_pieces.encode(docs, MODEL, decoded=True), MODEL, text="again")
    assert not both.filter("text <> again").count()
    return both


@pytest.mark.parametrize("block", [32 << 20, 500])
def test_pieces_are_the_library(spark, monkeypatch, block):
    monkeypatch.setattr(sentence_pieces, "BLOCK_BYTES", block)
    rows = table_rows(spark, SF) + awkward() + [(10_000 + i, t, "en", "s") for i, t in enumerate(odd_texts())] + [(77, "x" * 70_000 + " y", "en", "s")]
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in decoded(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, library([r[1] for r in rows]))), key=str)


def test_distinct_chunks_are_segmented_once(spark, monkeypatch):
    """The ids of all documents come from the table: each chunk is in one row of a block, and blocks meet by bucket."""
    rows = [(i, "the same words again\nthe same words again", "en", "s") for i in range(50)]
    docs = frame(spark, rows).repartition(4).select(F.struct("doc_id").alias("row"), "text")
    blocks = sentence_pieces._settled_blocks(docs, " \n")
    dealt = [(r["block"], r["bucket"], sentence_pieces._unpack_texts(r["texts"])) for r in blocks.filter("bucket is not null").collect()]
    for block in {d[0] for d in dealt}:
        assert sorted(t for d in dealt if d[0] == block for t in d[2]) == sorted([" the", " same", " words", " again", "\nthe"])
    assert len({(d[1], t) for d in dealt for t in d[2]}) == 5 and blocks.filter("b0 is not null").count() == 50


def test_whole_texts_where_the_model_allows_no_cut(spark, monkeypatch):
    assert sentence_pieces.Model(MODEL).cuts() == " \n"
    monkeypatch.setattr(sentence_pieces.Model, "cuts", lambda self: None)
    rows = awkward()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in decoded(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, library([r[1] for r in rows]))), key=str)


def test_pieces_of_an_empty_table(spark):
    assert not decoded(spark.createDataFrame([], SCHEMA)).collect()


# --- whitening ---

VECTORS = "vec_id long, embedding array<double>, n string, deviation string, id string, v string, k string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 6) for i, v in rows], VECTORS)


def covariance(xs):
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    return np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n) for j in range(d)] for i in range(d)])


def check_whitened(spark, rows, fit, components=None):
    """fit: the vectors that must be used, in integers."""
    got = whitening.components(vectors(spark, rows)).collect()
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    e = np.sort(np.linalg.eigvalsh(covariance(fit)))[::-1]
    k = components if components is not None else min(32, len(e))
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    want = sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in fit)
    assert sorted((r["deviation"] for r in got if r["component"] == 1), key=str) == sorted((w if w < 1 << 63 else None for w in want), key=str)
    for c in range(1, k + 1):
        own = [r for r in got if r["component"] == c]
        assert all(r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9, abs=1e-15) for r in own)
        assert sum(r["whitened"] ** 2 for r in own) / n == pytest.approx(1, abs=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)
    return got


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))
    nan, inf = float("nan"), float("inf")
    rows = [(i, x) for i, x in enumerate(good.tolist())] + [
        (1000, None), (1001, []), (1002, [None, *good[0, 1:].tolist()]), (1003, [nan, *good[0, 1:].tolist()]), (1004, [-inf, *good[0, 1:].tolist()]),
        (1005, [1e30, *good[0, 1:].tolist()]), (1006, [1.0, 2.0]), (None, good[3].tolist()), (7, good[7].tolist())]
    fit = [[math.floor(64 * c) + 1_000_000 for c in v] for v in [*good.tolist(), good[3].tolist(), good[7].tolist()]]
    got = check_whitened(spark, rows, fit)
    v = covariance(fit)
    values, axes = np.linalg.eigh(v)
    x = np.array(fit, float) - np.array(fit, float).mean(axis=0)
    for c in (1, 2, 17, 32):
        want = x[:300] @ axes[:, -c] / math.sqrt(values[-c])
        found = np.array([next(r["whitened"] for r in got if r["vec_id"] == i and r["component"] == c) for i in range(40)])
        sign = np.sign(found @ want[:40])
        np.testing.assert_allclose(found * sign, want[:40], atol=1e-9)


def test_equal_and_missing_variances(spark):
    """Axes of equal variance share a space; a constant axis has no component."""
    rows = [(i, [s * (i % 3 == j) / 4 for j in range(3)] + [2.5]) for i in range(30) for s in (1, -1)]
    fit = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    check_whitened(spark, rows, fit, components=3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(i, [0.5, 1.0]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.components(vectors(spark, rows))
    assert not found.collect() and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(s * 3 ** (i % 7 + 12)), float(i) * 1e7 / 64, (-1) ** i * 0.25]) for i, s in itertools.product(range(40), (1, -1))]
    fit = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    check_whitened(spark, rows, fit)


def test_polynomial_and_roots_are_exact():
    rng = random.Random(3)
    b = [[rng.randrange(-9, 10) for _ in range(6)] for _ in range(6)]
    m = [[sum(x * y for x, y in zip(r, s)) for s in b] for r in b]

    def determinant(a):
        if not a:
            return 1
        return sum((-1) ** j * a[0][j] * determinant([r[:j] + r[j + 1:] for r in a[1:]]) for j in range(len(a)))

    primes = whitening.primes_beyond(1 << 80)
    residues = [whitening.polynomial_mod(np.array(m) % p, p).tolist() for p in primes]
    c = [whitening.remainder(primes, list(r)) for r in zip(*residues)]
    for x in range(-3, 5):
        assert sum(a * x ** i for i, a in enumerate(c)) == determinant([[(x if i == j else 0) - m[i][j] for j in range(6)] for i in range(6)])
    roots = [whitening.kth_root(c, k, 20, sum(m[i][i] for i in range(6)) + 1) / (1 << 20) for k in range(1, 7)]
    np.testing.assert_allclose(roots, np.linalg.eigvalsh(np.array(m, float))[::-1], atol=1e-5)
    assert all(whitening.is_prime(p) for p in primes) and [x for x in range(60) if whitening.is_prime(x)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
