"""Near-duplicate documents by MinHash, confirmed on full shingle sets.

1. A document's words (ASCII lower case) become a set of 64-bit hashes of word shingles. Documents with one set are one
   class, joined by aggregation; a class is represented by its smallest id.
2. Many universal hash functions give minima; ``BAND`` minima make one bucket key. Two sets of similarity 0.8 share none
   of the 32 buckets with probability 5e-8.
3. Inside a bucket, signatures are compared by their low bytes; similar ones are linked to candidate clusters. The limit
   is five standard deviations below the threshold.
4. The texts of a cluster meet once, and every pair of the cluster is confirmed on the full sets, except pairs that
   links found before join already. Only a spanning forest of links leaves the task, never all pairs.
5. Components of the confirmed links by alternating large-star and small-star.

Large buckets and clusters are cut into blocks, and each pair of blocks is a task of its own, so a task holds at most
two blocks. Copies collapse in aggregations before that.

Defined cases: null or empty text, or text without words, has no shingle and is linked with nothing; fewer words than
``width`` are one shingle; rows that share an id are one document; rows with a null id are linked with nothing and kept;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import LOWER, Powers, chunks, mix, partitions, settle, spaces, words_of
from wattshift.llm.components import components

HASHES = 128
BAND = 4
BUCKET_BLOCK = 2048     # signatures of a block in the comparison inside a bucket
CLUSTER_BLOCK = 1024    # texts of a block in the comparison inside a cluster


def hash_functions(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n multiply-shift functions: the high half of a * x + b modulo 2^64."""
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int, tables: Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a chunk."""
    lower = np.frombuffer(LOWER, np.uint8)[data]
    h, _, _, doc = words_of(lower, ends, spaces(), tables)
    n_docs = len(ends) - 1
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    step = [np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(width)]
    full = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for j in range(width):
        full += h[j: j + len(full)] * step[j]
    full = mix(full)
    sets = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(full[a: b - width + 1]))
        elif b > a:
            short = np.uint64(0)
            for j in range(b - a):
                short = np.add(short, np.multiply(h[a + j], step[j]))
            sets.append(mix(np.array([short + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], n: int = HASHES) -> np.ndarray:
    """One row of n minima for every set; all sets have members."""
    a, b = hash_functions(n)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])]) if sets else np.zeros(0, np.int64)
    out = np.empty((len(sets), n), np.uint64)
    work = np.empty_like(flat)
    for k in range(n):
        np.multiply(flat, a[k], out=work)
        np.add(work, b[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts) if len(sets) else 0
    return out >> np.uint64(32)


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    n = signature.shape[1] // band
    parts = signature.reshape(len(signature), n, band)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(band):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for batch in batches:
            for rows, data, ends in chunks(batch):
                sets = shingle_sets(data, ends, width, tables)
                some = [s for s in sets if len(s)]
                at = np.flatnonzero([len(s) > 0 for s in sets])
                signature = signatures(some)
                keys, low, digest = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for i, s, k, v in zip(at.tolist(), some, band_keys(signature).view(np.int64), signature.astype(np.uint8)):
                    keys[i], low[i], digest[i] = k, v.tobytes(), hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(i) for i, f in enumerate(rows.schema) if f.name != "text"],
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                    [*[f.name for f in rows.schema if f.name != "text"], "n_shingles", "set_key", "keys", "low"])
    return run


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal keys with the runs' edges; the input is sorted by the key."""
    held: list[pa.RecordBatch] = []

    def split(table: pa.Table) -> np.ndarray:
        keys = table.column(key).to_numpy()
        return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        edges = split(table)
        if len(edges) > 1:
            yield table.slice(0, edges[-1]), edges.tolist()
            held = table.slice(edges[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, [*split(table).tolist(), table.num_rows]


def forest(n: int, linked) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph in which linked(i, others) says which of the others i is linked with."""
    left, queue = np.arange(n), []
    ones, twos = [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        hit = linked(i, left)
        found = left[hit]
        if len(found):
            ones.append(np.full(len(found), i))
            twos.append(found)
            queue.extend(found.tolist())
            left = left[~hit]
    empty = np.zeros(0, np.int64)
    return np.concatenate(ones or [empty]), np.concatenate(twos or [empty])


def _edges(nodes: np.ndarray, one: list[np.ndarray], two: list[np.ndarray]) -> pa.RecordBatch:
    empty = np.zeros(0, np.int64)
    a, b = nodes[np.concatenate(one or [empty])], nodes[np.concatenate(two or [empty])]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["u", "v"])


def _similar_signatures(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in runs(batches, "tile"):
            nodes = table.column("node").to_numpy()
            low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(nodes), -1)
            one, two = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                part = low[a:b]
                i, j = forest(b - a, lambda x, others, part=part: (part[others] == part[x]).sum(1) >= least)
                one.append(i + a)
                two.append(j + a)
            yield _edges(nodes, one, two)
    return run


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for table, edges in runs(batches, "tile"):
            nodes = table.column("node").to_numpy()
            one, two = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                sets = []
                for batch in table.slice(a, b - a).to_batches():
                    for _, data, ends in chunks(batch):
                        sets += shingle_sets(data, ends, width, tables)
                own_rows = np.flatnonzero([len(s) > 0 for s in sets]) + a    # an id may also have a row without words
                sets = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                values, ids = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.cumsum(sizes) - sizes
                mark = np.zeros(len(values), bool)

                def linked(x, others, ids=ids, starts=starts, sizes=sizes, mark=mark):
                    own = ids[starts[x]: starts[x] + sizes[x]]
                    mark[own] = True
                    if len(others) * 2 > len(sizes):
                        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)[others]
                    else:
                        both = np.array([np.count_nonzero(mark[ids[starts[y]: starts[y] + sizes[y]]]) for y in others.tolist()], np.int64)
                    mark[own] = False
                    return 100 * both >= percent * (sizes[others] + sizes[x] - both)

                i, j = forest(len(sets), linked)
                one.append(own_rows[i])
                two.append(own_rows[j])
            yield _edges(nodes, one, two)
    return run


def tiled(rows: DataFrame, group: str, size: Column, block: int) -> DataFrame:
    """rows with ``tile``: one per group, or one for every pair of blocks that the row's block belongs to."""
    blocks = F.ceil(size / block)
    mine = F.pmod(F.xxhash64("node"), blocks)
    tile = lambda j: F.xxhash64(F.col(group), F.least(mine, j), F.greatest(mine, j))
    return rows.withColumn("tile", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1), tile)))


def by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile", "node")


def candidate_clusters(described: DataFrame, percent: int) -> DataFrame:
    """(node, component): nodes whose signatures are near, by single linkage."""
    sim = percent / 100
    least = int(HASHES * (sim - 5 * (sim * (1 - sim) / HASHES) ** 0.5))
    keyed = described.filter("set_key is not null").select(
        F.col("doc_id"), F.xxhash64("set_key").alias("set_id"), F.explode("keys").alias("bucket"))
    members = keyed.groupBy("bucket", "set_id").agg(F.min("doc_id").alias("node"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = members.join(shared, "bucket").select("bucket", "size", "set_id", "node")
    low = described.filter("set_key is not null").groupBy(F.xxhash64("set_key").alias("set_id")).agg(F.first("low").alias("low"))
    tiles = by_tile(tiled(met.join(low, "set_id"), "bucket", F.col("size"), BUCKET_BLOCK).select("tile", "node", "low"))
    return components(tiles.mapInArrow(_similar_signatures(least), "u long, v long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest id reachable), kept.

    carry: further long columns of docs that the result shall have.
    """
    texts = docs.select("doc_id", "text")
    more = "".join(f"{c} long, " for c in carry)
    described = settle(docs.select("doc_id", *carry, "text").mapInArrow(
        _describe(width), f"doc_id long, {more}n_shingles long, set_key binary, keys array<long>, low binary"))
    known = described.filter("doc_id is not null")
    classes = settle(known.filter("set_key is not null").groupBy("set_key")
                     .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    clusters = settle(candidate_clusters(known, percent))
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inside = clusters.join(sizes, "component")
    met = texts.join(inside, texts["doc_id"] == inside["node"]).select("component", "size", "node", "text")
    tiles = by_tile(tiled(met, "component", F.col("size"), CLUSTER_BLOCK).select("tile", "node", "text"))
    links = components(tiles.mapInArrow(_confirmed(width, percent), "u long, v long"))
    named = (described.select("doc_id", *carry, "n_shingles", "set_key").join(classes, "set_key", "left")
             .withColumn("node", F.coalesce("node", "doc_id")).join(links, "node", "left"))
    smallest = F.coalesce("component", "node")
    return named.select("doc_id", *carry, "n_shingles", F.when(F.col("doc_id").isNotNull(), smallest).alias("component_id"),
                        F.coalesce(F.col("doc_id") == smallest, F.lit(True)).alias("kept"))
