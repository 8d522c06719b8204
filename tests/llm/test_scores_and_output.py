import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import A_TO_Z, SCHEMA, awkward, frame, table_rows, words
from pyspark.sql import functions as F

from wattshift.llm import licenses, ordinal, packing, token_store, toxicity
from wattshift.llm.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_licences_like_brute_force(spark):
    rows = table_rows(spark, SF) + awkward() + [
        (1_000_000, "Under the MIT license under the mit License, apache license: version 2.", None, None),
        (1_000_001, "CC BY-NC and permission is hereby granted", None, None), (1_000_002, "under the GNU General Public License version 3", None, None)]
    got = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        import re

        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_TO_Z))
        hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k: k + len(phrase.split())] == phrase.split()]
        base = sorted({label for _, label in hits})
        want = (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(base))
        assert want in [tuple(r)[1:6] for r in got[i]]
        assert all(set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got[i] if r.n_words == len(w))
    assert got[1_000_000][0].n_base == 3 and got[1_000_002][0].labels == "gpl-3"


def scan_of(spark, texts):
    """Labels and scores of texts amid plain ones, which make licence words rare."""
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(10_000 + k, f"the plain page {k} of this and that to be in a row", None, None) for k in range(300)]
    return {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect() if r.doc_id < 10_000}


def test_whole_templates_are_found(spark):
    got = scan_of(spark, [f"before it {t.title()} and after" for *_, t in licenses.TEMPLATES])
    assert all(label in got[k][0].split(",") and got[k][1] == 1.0 for k, (label, *_) in enumerate(licenses.TEMPLATES))


def test_changed_licences_are_found(spark):
    grant = next(t for label, _, _, t in licenses.TEMPLATES if label == "mit" and t.startswith("permission")).split()
    changed = [" ".join([*grant[:i], "altered", *grant[i + 1:]]) for i in range(20)] + [" ".join([*grant[:i], "put in", *grant[i:]]) for i in range(1, 20)]
    changed += [" ".join(grant[:i] + grant[i + 2:]) for i in range(0, 20, 3)]
    got = scan_of(spark, ["Distributed under the terms of the MIT license.", "SPDX-License-Identifier: Apache-2.0", *changed])
    assert got[0][0] == "mit" and got[1][0] == "apache-2"
    assert all(got[k][0] == "mit" and got[k][1] >= licenses.SHARE for k in range(2, len(changed) + 2))


def test_licence_words_apart_are_no_licence(spark):
    rng = np.random.default_rng(5)
    mixed = [" ".join(rng.permutation(t.split())) for *_, t in licenses.TEMPLATES if len(t.split()) > 12]
    loose = " ".join(f"{w} far from it here there and back" for w in licenses.TEMPLATES[3][3].split())
    got = scan_of(spark, [*mixed, loose, "She studied at MIT. Her license came later.", "mit " * 5000, "the license " * 5000])
    assert all(labels == "" and score == 0 for labels, score in got.values())


def plain_labels(index, text):
    """Every start and every place looked at; key phrases by plain search."""
    w, labels, best = licenses.split_words(text), set(), 0.0
    for t in index.templates:
        hits = {(i - j, j) for j in range(len(t.words)) if t.weights[j] for i, x in enumerate(w) if x == t.words[j]}
        for s in {s for s, _ in hits}:
            near = [(a, j) for a, j in hits if s - licenses.DRIFT <= a <= s]
            share = sum(t.weights[j] for j in {j for _, j in near}) / t.weights.sum()
            inside = b" " + b" ".join(w[max(0, min(a for a, _ in near)): s + len(t.words)]) + b" "
            if share >= licenses.SHARE and sum(b" " + b" ".join(k) + b" " in inside for k in t.keys) >= t.need:
                labels.add(t.label)
                best = max(best, share)
    return labels, best


def test_licence_index_like_brute_force():
    rng = np.random.default_rng(11)
    vocabulary = licenses.vocabulary()
    index = licenses.Index({"": 5000, **{w: int(rng.integers(0, 5000)) for w in vocabulary}})
    found = 0
    for _ in range(400):
        text = []
        for _ in range(rng.integers(1, 5)):
            part = str(licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))][3]).split()
            for _ in range(rng.integers(0, 4)):
                i = int(rng.integers(len(part) + 1))
                part[i: i + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary))] * int(rng.integers(0, 3))
            text += part + [str(rng.choice(vocabulary)) for _ in range(rng.integers(0, 6))]
        words_ = licenses.split_words(" ".join(text))
        labels, best = index.scan(words_, set(words_))
        want, share = plain_labels(index, " ".join(text))
        assert labels == want and best == pytest.approx(share)
        found += bool(labels)
    assert 100 < found < 400


def test_classifiers_on_held_out_rows(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    toxic = [(r.score, labels[r.doc_id].toxic) for r in QUERIES["op6_toxicity"](spark, LARGER).collect() if r.held_out and r.doc_id in labels]
    ranked = np.argsort(np.argsort([s for s, _ in toxic])) + 1
    y = np.array([t for _, t in toxic])
    auc = (ranked[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95
    flagged = [t for s, t in toxic if s >= 0.7]
    assert np.mean(flagged) > 0.95 and sum(flagged) > 0.5 * y.sum()
    graded = [(r.kept, r.expected_grade, labels[r.doc_id].quality) for r in QUERIES["op8_quality_grade"](spark, LARGER).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([k for k, _, q in graded if q == 1]) > 0.99 and np.mean([k for k, _, q in graded if q == 0]) < 0.05


def test_held_out_labels_change_nothing(spark):
    rows = table_rows(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    crooked = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = frame(spark, rows)
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, crooked).collect())


def test_awkward_rows_get_scores(spark):
    docs, labels = frame(spark, awkward()), spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 5)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        scores = toxicity.toxicity(docs, labelled).collect()
        assert len(scores) == len(awkward()) and all(r.score == pytest.approx(0.5) and r.predicted == 0 for r in scores)
        grades = ordinal.grade(docs, labelled, F.col("quality")).collect()
        assert len(grades) == len(awkward()) and all(0 <= r.expected_grade <= 2 for r in grades)


def test_ordinal_gradient():
    params = ordinal.OrdinalParams(rate=1e-6, l2=0.0)
    x, slots = np.array([0.6, 0.8]), np.array([3, 9])

    def loss(w, t, grade):
        tails = [1.0, *ordinal.sigmoid(w @ x - t), 0.0]
        return -math.log(tails[grade] - tails[grade + 1])

    for grade in range(3):
        m = ordinal.Ordinal(params, np.array([0.3, 0.3, 0.4]))
        m.w[slots] = [0.5, -0.2]
        w, t = m.w[slots].copy(), m.t.copy()
        numeric = [(loss(w + d, t, grade) - loss(w - d, t, grade)) / 2e-5 for d in np.eye(2) * 1e-5]
        m.learn(slots, x, grade)
        np.testing.assert_allclose(np.sqrt(m.gw[slots] - 1e-8), np.abs(numeric), rtol=1e-4)
        np.testing.assert_array_equal(np.sign(w - m.w[slots]), np.sign(numeric))
        assert (np.diff(m.t) >= params.gap - 1e-12).all()


def test_encoder_is_the_library():
    encoder = token_store.Encoder(BPE)
    texts = ["", " ", "a", "\n\nx  y\t z ", "it's 12,5% <|endoftext|> x", "naïve café x", "数字 ok", "x\x1cy", " lead", "trail ", "a\r\nb", "“q” – €5", "don't we'll"]
    expected = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
    assert encoder.by_piece and encoder.encode(texts) == expected == encoder.encode(texts)


def test_encoder_is_the_library_on_random_texts(monkeypatch):
    """Pieces of usual characters, a cache that is too small, and texts that go whole."""
    import random

    monkeypatch.setattr(token_store, "CACHE_PIECES", 700)
    encoder, rng = token_store.Encoder(BPE), random.Random(2)
    usual = [chr(c) for c in token_store.USUAL]
    letters = list(" \n\t''stremvl’“”–€²½éßÑ0123456789abcXYZ.,!") * 3 + usual
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 300]))) for _ in range(3000)]
    texts[::50] = [t + rng.choice(["\x1f", "\x85", "数", "\u2028", "<|endoftext|>", "🙂"]) for t in texts[::50]]
    for at in range(0, len(texts), 100):
        part = texts[at: at + 100]
        assert encoder.encode(part) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in part]
        assert len(encoder._size) == len(encoder._number) <= 700
    usual_text = re.compile(token_store.UNUSUAL).search
    assert not any(usual_text(c) for c in usual) and all(usual_text(chr(c)) for c in range(0x3000) if c not in set(token_store.USUAL) and not 0xD800 <= c < 0xE000)


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        index = token_store.Index.build(keys, 0, np.arange(len(keys) + 1), "<u2")
        again = token_store.Index.from_bytes(index.to_bytes())
        assert sorted(again.hash.slots(keys).tolist()) == list(range(len(keys)))
        first, rows = again.find(keys)
        assert (first == np.arange(len(keys))).all() and (rows == 1).all()
        _, strange = again.find(rng.integers(1 << 62, (1 << 63) - 1, 2000))
        assert strange.sum() <= 1


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = table_rows(spark, SF) + awkward()
    docs = frame(spark, rows)
    manifest = token_store.write(docs, str(tmp_path / "store"), BPE, 5)
    keys = docs.select("doc_id").distinct().union(spark.createDataFrame([(123_456_789,)], "doc_id long"))
    got = sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_store.lookup(keys, manifest, str(tmp_path / "store")).collect())
    t, at, want = Tokenizer.from_file(BPE), 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((at, str(i), len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    assert got == want


def best_fit(sizes, capacity):
    """Plain statement: (size, source, cluster) in order -> bins as lists of items."""
    bins = []
    for size, source, cluster in sizes:
        open_ = [b for b in bins if sum(x[0] for x in b) + size <= capacity
                 and not any((x[1] == source and source is not None) or (x[2] == cluster and cluster is not None) for x in b)]
        if open_:
            min(open_, key=lambda b: (capacity - sum(x[0] for x in b), bins.index(b))).append((size, source, cluster))
        else:
            bins.append([(size, source, cluster)])
    return bins


def test_packing_like_brute_force():
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 300
    df = pd.DataFrame({"doc_id": np.arange(n), "k_text": 0, "source": rng.choice(["a", "a", "b", "c", None], n), "cluster": rng.choice([*"pqrstuvwxyz", None], n),
                       "piece": 0, "size": rng.integers(1, 60, n), "grp": 0})
    out = packing.pack_group(100)(df.copy())
    order = df.sort_values(["size", "doc_id"], ascending=[False, True])
    none = lambda v: None if pd.isna(v) else v
    bins = best_fit([(s, none(a), none(c)) for s, a, c in zip(order["size"], order.source, order.cluster)], 100)
    assert sorted(out.groupby("bin")["size"].apply(lambda s: sorted(s.tolist()))) == sorted(sorted(x[0] for x in b) for b in bins)


def test_packing_keeps_every_word(spark):
    rows = table_rows(spark, SF) + awkward()
    got = packing.pack(frame(spark, rows), F.xxhash64("text"), capacity=700, group_rows=60).collect()
    assert sum(r.n_words for r in got) == sum(len(words(r[1])) for r in rows)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    source = {r[0]: r[3] for r in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.start)
        assert all(a.start + a.n_words == b.start for a, b in zip(held, held[1:])) and held[0].start == 0
        assert held[-1].start + held[-1].n_words <= 700
        named = [source[r.doc_id] for r in held if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(named) == len(set(named))


def test_near_copies_share_no_bin(spark):
    """A changed comma or word lifts no constraint, whatever the sources; null ids go by their text."""
    base = [" ".join(f"w{k}x{i * 13 % 89}" for i in range(90)) for k in range(4)]
    rows = [(10 * k + j, t.replace(f"w{k}x13 ", f"w{k}x13, " if j % 2 else f"new{j} "), None, f"src{k}-{j}") for k, t in enumerate(base) for j in range(6)]
    rows += [(None, base[0], None, "n1"), (None, base[0].upper(), None, "n2"), *awkward()]
    docs = frame(spark, rows)
    got = packing.pack(docs, packing.near_copies(docs), capacity=4000, group_rows=1000).collect()
    assert sum(r.n_words for r in got) == sum(len(words(r[1])) for r in rows)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    for held in bins.values():
        named = [i // 10 for i in held if i is not None and 0 <= i < 40]
        assert len(named) == len(set(named)) and held.count(None) <= 3   # two of the awkward rows, one of ours
    assert any(len({i // 10 for i in held if i is not None and 0 <= i < 40}) > 1 for held in bins.values())


def test_empty_tables(spark, tmp_path):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not toxicity.toxicity(docs, labels).collect()
    assert not ordinal.grade(docs, labels, F.col("quality")).collect()
    assert not licenses.scan(docs).collect()
    assert not packing.pack(docs, F.lit(1)).collect() and not packing.pack(docs, packing.near_copies(docs)).collect()
    assert not token_store.encode_and_read(spark, docs, BPE).collect()
