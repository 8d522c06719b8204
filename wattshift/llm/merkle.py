"""Merkle manifest of a dataset: leaves, subtree roots per group, one root, and an inclusion proof for every row.

A leaf is the digest of a row's fields. The leaves of a group, numbered in order, are its tree's lowest nodes; ``fanout``
consecutive nodes become their parent's digest until one node, the subroot, remains. The subroots, in order of their groups,
are the lowest nodes of the top tree.

Method: a slot pivot. Node ``i`` sits in slot ``i mod fanout`` of parent ``i div fanout``; conditional aggregates spread
a parent's children into ``fanout`` columns, concatenating the columns gives the parent's digest, and the columns before and
behind a child's own slot are its siblings. Nodes are dealt by (tree, block of ``BLOCK_LEVELS`` levels) in one exchange; all levels
inside a block aggregate where the rows lie, and the rows ride along with their proofs so far. One small row a block goes on to the next
levels, so a hot group is split like any other.

Texts are read once and only digests move. Defined cases: a null field counts as ``-``, so it differs from an empty one; a
null group is a group of its own and comes first; rows of equal order value (null ones first) are ordered by their digest, and
identical rows are leaves of their own; a group of one row has its leaf as subroot; an empty table has no rows; only the
named columns are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshift.llm.common import partitions, settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_NODES = 1024             # nodes of one level that a block holds
BROADCAST_STARTS = 1_000_000   # first numbers of (tree, partition); beyond, they are joined by shuffle
PLACE_BITS = 33                # of monotonically_increasing_id: the place inside a partition
ONE_TREE = "="
PATH = "array<struct<before:string,after:string>>"


def digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of texts behind one another; null counts as empty."""
    return F.sha2(F.concat(*[F.coalesce(v, F.lit("")) for v in values]), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of fields, each ``-`` if null, else its length in bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return digest([F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda node, x: digest([x["before"], node, x["after"]]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(tree, idx, n, *others) with the dense place of every row in its tree and the tree's size; and the largest size.

    Rows are sorted by range; a partition's rows are counted per tree, and one small row per (tree, partition) is summed up.
    """
    marked = settle(rows).withColumn("_at", F.monotonically_increasing_id())   # identical rows spread over partitions
    keys = ["tree", *order, "_at"]
    parts = partitions(rows.sparkSession)
    placed = settle(marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_at"))
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    tree = Window.partitionBy("tree")
    starts = settle(
        placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .select("tree", "_part", "_first",
                F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                F.sum("_rows").over(tree).alias("n")))
    told = starts.agg(F.count(F.lit(1)).alias("starts"), F.max("n").alias("largest")).first()
    if told["starts"] <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    joined = placed.join(starts, ["tree", "_part"]).withColumn("idx", F.col("_before") + F.col("_place") - F.col("_first"))
    return joined.drop("_part", "_place", "_first", "_before"), told["largest"] or 0


def _climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (tree, idx, n, hash, item) to one row per block: (tree, idx, n, hash, items), items with their path inside the block.

    A tree that is down to one node stays as it is. The levels are alike, so their expressions are texts made once.
    """
    nothing = f"cast(array() AS {PATH})"
    slots = range(fanout)
    pivot = [F.expr(f"first(CASE WHEN idx % {fanout} = {s} THEN {c} END, true)").alias(f"{c[0]}{s}") for s in slots for c in ("hash", "items")]
    parent = F.expr(f"idx div {fanout}").alias("idx")

    def joined(own: range) -> str:
        return "concat('', " + ", ".join(["''", *[f"coalesce(h{s}, '')" for s in own]]) + ")"

    def above(s: int) -> str:
        beside = f"named_struct('before', {joined(range(s))}, 'after', {joined(range(s + 1, fanout))})"
        longer = f"transform(i{s}, x -> named_struct('item', x.item, 'path', concat(x.path, array({beside}))))"
        return f"CASE WHEN i{s} IS NULL THEN array() WHEN n > 1 THEN {longer} ELSE i{s} END"

    step = ["tree", "block", "idx", f"(n + {fanout - 1}) div {fanout} AS n",
            f"CASE WHEN n > 1 THEN sha2({joined(slots)}, 256) ELSE h0 END AS hash",
            f"concat({', '.join(above(s) for s in slots)}) AS items"]
    at = nodes.selectExpr("tree", f"idx div {fanout ** levels} AS block", "idx", "n", "hash", "item").repartition("tree", "block").selectExpr(
        "tree", "block", "idx", "n", "hash", f"array(named_struct('item', item, 'path', {nothing})) AS items")
    for _ in range(levels):
        at = at.groupBy("tree", "block", "n", parent).agg(*pivot).selectExpr(*step)
    return at.drop("block")


def _grow(rows: DataFrame, order: list[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every stage, lowest first, and the last node of every tree (tree, hash)."""
    nodes, largest = _numbered(rows, order)
    stages: list[DataFrame] = []
    while True:
        levels = next(b for b in range(1, 64) if fanout ** b >= largest or fanout ** (b + 1) > BLOCK_NODES)
        stages.append(settle(_climb(nodes, fanout, levels)))
        largest = -(-largest // fanout ** levels)
        if largest <= 1:
            return stages, stages[-1].select("tree", "hash")
        nodes = stages[-1].select("tree", "idx", "n", "hash", F.col("idx").alias("item"))


def _descend(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """Items of the lowest stage with their whole path; above: (tree, upper path, *others) of every tree, carried along."""
    carried = above.columns
    for number, blocks in enumerate(reversed(stages)):
        keys = ["tree"] if number == 0 else ["tree", "idx"]
        opened = blocks.select(*keys, "items").join(above, keys).select(
            *[c for c in carried if c != "upper"], "upper", F.explode("items").alias("x"))
        last = number == len(stages) - 1
        above = opened.select(
            *[c for c in carried if c != "upper"], F.concat("x.path", "upper").alias("upper"), F.col("x.item").alias("item" if last else "idx"))
    return above


def manifest(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, fanout: int = 2,
    changed: tuple[Column, Sequence[Column]] | None = None, carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per row of docs: the carried columns, leaf, changed_leaf, subroot, root and path (array of before, after).

    ``changed`` is a condition and the fields that are found later where it holds; changed_leaf is their digest, elsewhere the leaf.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    leaf = leaf_of([F.col(f"`{c}`") for c in fields])
    item = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row")
    rows = docs.select(
        F.coalesce(F.concat(F.lit(ONE_TREE), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{order}`").alias("place"), leaf.alias("hash"),
        (F.when(changed[0], leaf_of(changed[1])) if changed else F.lit(None).cast("string")).alias("changed"), item)
    rows = rows.select("tree", "place", "hash", F.struct("row", F.col("hash").alias("leaf"), F.coalesce("changed", "hash").alias("changed")).alias("item"))
    stages, subroots = _grow(rows, ["place", "hash"], fanout)
    tops = subroots.select(F.lit(ONE_TREE).alias("tree"), F.col("tree").alias("place"), "hash",
                           F.struct(F.col("tree").alias("tree"), F.col("hash").alias("subroot")).alias("item"))
    top_stages, root = _grow(tops, ["place"], fanout)
    nothing = F.array().cast(PATH).alias("upper")
    above = settle(_descend(top_stages, root.select("tree", nothing, F.col("hash").alias("root")))).select(
        F.col("item.tree").alias("tree"), F.col("item.subroot").alias("subroot"), "root", "upper")
    found = _descend(stages, above)
    return found.select(*[F.col("item.row").getField(c).alias(c) for c in carry], F.col("item.leaf").alias("leaf"),
                        F.col("item.changed").alias("changed_leaf"), "subroot", "root", F.col("upper").alias("path"))


def tampered(every: int = 7) -> tuple[Column, list[Column]]:
    """Documents of which ``every`` divides the CRC-32 of the decimal doc_id, and their fields with one added to n_chars; nulls stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return hit, [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]


def verify(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, checked against documents of which some have been tampered with."""
    rows = manifest(docs, changed=tampered())
    fold = folded(F.col("changed_leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
