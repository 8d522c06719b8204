"""The registered queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.llm import decontaminate, licenses, line_dedup, merkle, minhash, ordinal, packing, quality_rules, sentence_pieces, suffix_dedup, token_store, toxicity, whitening
from wattshift.llm.common import documents, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), texts=False).drop("kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Grades: 0 poor, 1 good but toxic, 2 good.
    rating = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0)))
    graded = ordinal.grade(documents(spark, sf_dir), table(spark, sf_dir, "labels"), rating)
    return graded.select("doc_id", "held_out", "expected_grade", F.get("tails", F.lit(0)).alias("p_good"),
                         F.get("tails", F.lit(1)).alias("p_clean"), "kept")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=4)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.encode_and_read(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_items", "item_ids", (F.col("n_items") == 0).alias("kept"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return packing.pack(docs, packing.near_copies(docs))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.encode(documents(spark, sf_dir), model, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_license_scan, op3_quality_rules, op4_line_dedup, op5_token_ids, op6_toxicity,
                                 op7_benchmark_decontamination, op8_quality_grade,
                                 op9_minhash_near_dedup, op10_best_fit_packing, op11_sentencepiece, op12_merkle_manifest, op13_embedding_whitening)}
