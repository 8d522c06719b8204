import hashlib
import random
import tempfile
import threading

import numpy as np
import pytest
from cases import SCHEMA, awkward, frame, near_groups, shingles, table_rows

from wattshift.llm import components, minhash, suffix_dedup
from wattshift.llm.common import Powers, flat_text, spaces, words_of
from wattshift.llm.induced import Shard

SF = "/root/testdata/sf0.001"


def brute_repeats(rows, span):
    """Per row (id, text): bytes, removed, runs, digest. Equal rows are one document; order by id (null first), then hash."""
    seen, out = set(), {}
    for key in rows:
        raw = (key[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            s = raw[p: p + span]
            if s in seen:
                gone[p: p + span] = b"\1" * span
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[key[0], key[1] or ""] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("span, gram", [(100, 20), (12, 4), (3, 2)])
def test_repeats_like_brute_force(spark, span, gram, monkeypatch):
    if span == 12:
        monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", 1)     # every anchor with several texts is split
    random.seed(span)
    parts = ["".join(random.choices("abc ", k=20)) for _ in range(12)]
    rows = [(i, "".join(random.choices(parts, k=random.randint(0, 25))) if i % 5 else "ab" * (i * 3), None, None) for i in range(40)]
    rows += awkward() if span == 100 else []
    docs = frame(spark, rows)
    order = {(r.doc_id, r.text or ""): r.k_text for r in suffix_dedup.keyed(docs).collect()}
    plain = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, order[r]))
    expected = brute_repeats(plain, span)
    got = suffix_dedup.remove_repeats(docs, span, gram).collect()
    digests = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert digests == sorted((str(r[0]), *expected[r[0], r[1] or ""]) for r in rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_by_shuffle_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(suffix_dedup.remove_repeats(docs, texts=False).collect())
    monkeypatch.setattr(suffix_dedup, "BROADCAST_RANGES", 0)
    assert sorted(suffix_dedup.remove_repeats(docs, texts=False).collect()) == want


@pytest.mark.parametrize("memory", [0, 7, 1 << 20])
def test_induced_order(memory):
    random.seed(memory)
    for trial in range(150):
        depth, letters = random.choice([1, 2, 5, 40]), random.randint(1, 4)
        raw = bytes(random.randint(0, letters) for _ in range(random.randint(1, 60)))
        with tempfile.TemporaryDirectory() as folder:
            blocks = list(Shard(np.frombuffer(raw, np.uint8), depth, folder, memory).order())
        at, prefix = (np.concatenate(x).tolist() for x in zip(*blocks))
        assert sorted(at) == list(range(len(raw)))
        cut = [raw[i: i + depth] for i in at]
        assert cut == sorted(cut)
        for k in range(1, len(cut)):
            same = 0
            while same < min(len(cut[k]), len(cut[k - 1])) and cut[k][same] == cut[k - 1][same]:
                same += 1
            assert prefix[k] == same


def anonymous_mb():
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) / 1024


def sort_shard(size):
    """Peak of memory held and time of sorting a shard of words with repeated passages."""
    rng = np.random.default_rng(3)
    words = rng.integers(97, 123, (5000, 6), np.uint8)
    words[:, 5] = 32
    raw = words[np.minimum(rng.zipf(1.3, size // 6), 5000) - 1].ravel()
    raw[len(raw) // 2: len(raw) // 2 + 100_000] = raw[:100_000]
    peaks, done = [], threading.Event()

    def watch():
        while not done.wait(0.02):
            peaks.append(anonymous_mb())

    with tempfile.TemporaryDirectory() as folder:
        raw.tofile(f"{folder}/text")
        text, n = np.memmap(f"{folder}/text", np.uint8, "r"), len(raw)
        del raw
        before, last, repeated = anonymous_mb(), None, 0
        watcher = threading.Thread(target=watch)
        watcher.start()
        for at, prefix in Shard(text, 100, folder).order():
            n, repeated = n - len(at), repeated + int((prefix == 100).sum())
            here = bytes(text[at[0]: at[0] + 100])
            assert last is None or last <= here
            last = here
        done.set()
        watcher.join()
    assert n == 0 and repeated >= 99_900
    return max(peaks) - before


def test_memory_does_not_follow_the_shard():
    small, large = sort_shard(4 << 20), sort_shard(16 << 20)
    assert large < 300 and large < 2 * small + 50


def test_near_duplicates_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 3)      # clusters and buckets of several blocks
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 3)
    rows = table_rows(spark, SF) + awkward()
    for width in (4, 5):
        want = near_groups(rows, width)
        for r in minhash.near_duplicates(frame(spark, rows), width).collect():
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = sorted(str((r.doc_id, r.n_shingles)) for r in minhash.near_duplicates(frame(spark, awkward()), 4).collect())
    assert sizes == sorted(str((r[0], len(shingles(r[1], 4)))) for r in awkward())


def test_chains_reach_their_smallest_id(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 300), (300, 250), (7, 7), (5, 6), (6, 5), (None, 1)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {200: 200, 250: 200, 300: 200}


def test_words_of_flat_text():
    import pyarrow as pa

    texts = ["ab  c", None, "", "é x\n", "  ", "c"]
    data, ends = flat_text(pa.array(texts).slice(0))
    h, start, stop, doc = words_of(data, ends, spaces(), Powers())
    found = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(start, stop, doc)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    assert len(set(h.tolist())) == len({w for _, w in found})


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not minhash.near_duplicates(empty).collect()
    assert not suffix_dedup.remove_repeats(empty).collect()
