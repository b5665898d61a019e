"""The given tables and vocabulary files, as the queries and the pipeline use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clerkwise.llm.frames import id_remainder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents_and_labels(spark: SparkSession, folder: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their fold, and the labels that may be learned from."""
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = table(spark, folder, "labels").where(~held_out & F.col(label).isNotNull()).select("doc_id", label)
    return docs, labels


def vocabulary() -> dict[str, str]:
    """The installed vocabulary files; any other tokenizer file may be given to the operator instead."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}
