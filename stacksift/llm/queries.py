"""One query for each training-data operator, over its whole table, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contract_sql, conversations, decontaminate, fingerprints, hard_negatives, hilbert, html_crf, licenses, line_dedup, near_dup, pii, secrets, toxicity
from .common import table


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"n_{k}" for k in pii.KINDS]
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", *counts)


def op2_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_pages(table(spark, sf_dir, "pages"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(table(spark, sf_dir, "documents"))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_probminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op10_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = conversations.repair(table(spark, sf_dir, "conversations"))
    return report


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_feistel_pseudonyms, op2_secret_grammar, op3_boosted_toxicity, op4_bottom_k_fingerprints, op5_crf_main_text, op6_hilbert_shards, op7_latent_decontamination, op8_license_classifier, op9_probminhash_near_dup, op10_bpe_segment_tree, op11_line_dedup, op12_conversation_repair, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": contract_sql.OP11_SQL, "op12_conversation_repair": contract_sql.OP12_SQL, "op13_hard_negatives": contract_sql.OP13_SQL}
