"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clerkwise.llm import oracles
from clerkwise.llm.banding import fingerprint_groups
from clerkwise.llm.contamination import contamination
from clerkwise.llm.conversations import audit_conversations, damage
from clerkwise.llm.frames import id_remainder
from clerkwise.llm.hard_negatives import mine_hard_negatives
from clerkwise.llm.inputs import documents_and_labels, table, vocabulary
from clerkwise.llm.language import fit_language, identify_language
from clerkwise.llm.line_windows import drop_repeated_lines
from clerkwise.llm.near_duplicates import near_duplicates
from clerkwise.llm.packing import pack_documents
from clerkwise.llm.passages import drop_repeated_passages
from clerkwise.llm.quality import fit_quality, score_quality
from clerkwise.llm.sharding import SHARDS, assign_shards
from clerkwise.llm.substrings import drop_repeated_bytes
from clerkwise.llm.toxicity import fit_toxicity, score_toxicity


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    rest = id_remainder(F.col("doc_id"), 4)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (rest == 2).alias("held_out"))
    model = fit_language(docs.where(~F.col("held_out")))
    out = identify_language(docs.select("doc_id", "held_out", "text"), model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents_and_labels(spark, folder, "toxic")
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model, ("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, folder, "documents").select("doc_id", "text"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_groups(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(F.array_distinct("matches.item_id")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_passages(table(spark, folder, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents_and_labels(spark, folder, "quality")
    model = fit_quality(docs, labels)
    return score_quality(docs, model, ("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), **vocabulary())


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"), [1.0] * SHARDS)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations")
    return audit_conversations(damage(talks), talks)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_decontamination": op5_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_sharding": op11_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": oracles.CONTAMINATION,
    "op6_minhash_near_dedup": oracles.NEAR,
    "op7_substring_dedup": oracles.PASSAGES,
    "op10_line_dedup": oracles.LINES,
    "op11_sharding": oracles.SHARDS,
    "op12_conversation_repair": oracles.REPAIR,
    "op13_hard_negatives": oracles.NEGATIVES,
}


if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
