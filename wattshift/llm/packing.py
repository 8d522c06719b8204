"""Packing of documents into sequences of fixed length by conflict-constrained best fit.

Documents are cut into pieces of at most ``capacity`` words; whole pieces fill a bin of their own, the rest is packed:
longest first, into the bin with the least room that is enough. A bin carries a bitmap of its sources and one of its
duplicate clusters, and takes no second piece of a source or a cluster; the search goes on to the next tightest bin
until one is compatible, or opens a new one.

Pieces are spread over packing groups of about ``group_rows`` by a hash of their id, so that a hot source is spread
evenly, and every group is packed by one task. The number of groups follows the number of documents. Only ids, lengths, source and
cluster reach these tasks, never texts.

Defined cases: null text and texts without words have no piece and no row; null source or cluster conflicts with nothing;
ties go to the smaller id, then the text's hash; repeated rows are packed each (their copies are numbered), and conflict with each other as one cluster;
an empty table gives an empty result; extra columns are not read.

Near copies: ``near_copies`` gives every row its near-duplicate component as cluster (five-word shingles, similarity 0.8); a row without id or
without shingles takes its lower-cased text.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshift.llm.common import row_key, settle
from wattshift.llm.minhash import near_duplicates

CAPACITY = 2048
GROUP_ROWS = 5000


class Bins:
    """Open bins ordered by (room, number), each with exact bitmaps of what it holds."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []     # (room left, bin), sorted
        self.sources: list[int] = []               # bitmaps, bit = number of the source or cluster in this group
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) of a piece; source and cluster are single-bit masks, 0 for none."""
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            room, b = self.order[i]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.order[i]
                break
            i += 1
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room > size:
            insort(self.order, (room - size, b))
        return b, self.capacity - room


def pack_group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["size", "doc_id", "k_text", "piece"], ascending=[False, True, True, True], kind="stable", na_position="first")
        bits = {}
        for name in ("source", "cluster"):
            codes, _ = pd.factorize(pieces[name])
            repeated = np.bincount(codes[codes >= 0]) > 1 if (codes >= 0).any() else np.zeros(0, bool)
            dense = np.cumsum(repeated) - 1      # only what occurs twice can conflict and needs a bit
            bits[name] = [1 << int(dense[c]) if c >= 0 and repeated[c] else 0 for c in codes]
        bins = Bins(capacity)
        placed = [bins.place(*x) for x in zip(pieces["size"].tolist(), bits["source"], bits["cluster"])]
        pieces["bin"] = [b for b, _ in placed]
        pieces["start"] = [s for _, s in placed]
        return pieces[["doc_id", "piece", "size", "grp", "bin", "start"]]
    return run


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, cluster) of docs (doc_id, text): the cluster is equal for copies and near copies."""
    keyed = docs.select("doc_id", "text", *row_key())
    found = near_duplicates(keyed, carry=("k_id", "k_text")).select(
        "k_id", "k_text", F.concat(F.lit("c"), F.col("component_id").cast("string")).alias("cluster"))
    alone = keyed.filter("doc_id is null").select("k_id", "k_text", F.concat(F.lit("t"), F.hex(F.xxhash64(F.lower("text")))).alias("cluster"))
    return found.filter("cluster is not null").unionByName(alone)


def pack(docs: DataFrame, cluster: Column | DataFrame, source: str = "source", capacity: int = CAPACITY,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, bin_id, start (words before it in its bin).

    docs: doc_id, text and the source column; cluster: what must not meet in a bin where it is equal, as an expression over docs, or
    as rows (k_id, k_text, cluster) for the keys of ``row_key``. Such rows are joined once texts have become lengths.
    """
    keyed = isinstance(cluster, DataFrame)
    own = F.lit(None) if keyed else cluster
    counted = (docs.select("doc_id", F.col(source).cast("string").alias("source"), own.cast("string").alias("cluster"),
                           *row_key(), word_count(F.col("text")).alias("words")).filter("words > 0")
               .groupBy("doc_id", "source", "cluster", "k_id", "k_text", "words").agg(F.count(F.lit(1)).alias("copies")))
    if keyed:
        named = cluster.select("k_id", "k_text", F.col("cluster").cast("string").alias("cluster")).dropDuplicates(["k_id", "k_text"])
        counted = counted.drop("cluster").join(named, ["k_id", "k_text"], "left")
    sized = settle(counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")))
    whole = F.floor(F.col("words") / capacity)
    filled = sized.filter(F.col("words") >= capacity).select("doc_id", "k_text", "copy", F.explode(F.sequence(F.lit(1).cast("long"), whole)).alias("piece"))
    filled = filled.select("doc_id", (F.col("piece") - 1).alias("piece"), F.lit(capacity).cast("long").alias("n_words"),
                           F.concat(F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.hex("k_text"),
                                    F.lit("-"), F.col("copy").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), F.lit(0).cast("long").alias("start"))
    rest = sized.filter(F.col("words") % capacity > 0).select(
        "doc_id", "k_text", "source", "cluster", whole.cast("long").alias("piece"), (F.col("words") % capacity).alias("size"))
    groups = max(1, -(-rest.count() // group_rows))
    grouped = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "k_text"), F.lit(groups)))
    packed = grouped.groupBy("grp").applyInPandas(
        pack_group(capacity), "doc_id long, piece long, size long, grp long, bin long, start long")
    return filled.unionByName(packed.select("doc_id", "piece", F.col("size").alias("n_words"),
                                            F.format_string("g%d-%d", "grp", "bin").alias("bin_id"), "start"))
