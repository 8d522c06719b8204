"""Cleaning of a document collection: STAGES in order, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.llm.common import boxed, documents, row_key, table
from wattshift.llm.decontaminate import contamination
from wattshift.llm.line_dedup import drop_boilerplate
from wattshift.llm.minhash import near_duplicates
from wattshift.llm.packing import pack
from wattshift.llm.quality_rules import quality_rules
from wattshift.session import scratch_path


def _rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(row, k_id, k_text) of the rows of docs whose keys are in kept."""
    return boxed(docs).join(kept.select("k_id", "k_text").distinct(), ["k_id", "k_text"], "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    verdict = quality_rules(docs, table(spark, sf_dir, "labels"), carry=row_key())
    return _rows(docs, verdict.filter("kept")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; copies count once here, since the next stage settles them."""
    cleaned = drop_boilerplate(docs, counts=False, copies_once=True)
    return cleaned.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c
                            for c in docs.columns])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of copies and near copies stays, the one with the smallest id; of repeated rows one."""
    marked = near_duplicates(docs.select("doc_id", "text", *row_key()), carry=("k_id", "k_text"))
    return _rows(docs, marked.filter("kept")).dropDuplicates(["k_id", "k_text"]).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = boxed(docs)
    held = contamination(keyed.select("k_id", "k_text", F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"))
    return keyed.join(held.select("k_id", "k_text").distinct(), ["k_id", "k_text"], "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return pack(docs, F.xxhash64(F.lower("text")))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicate),
          ("benchmark_decontamination", decontaminated), ("best_fit_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
