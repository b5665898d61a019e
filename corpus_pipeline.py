"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), ``docs`` being what its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clerkwise.llm.contamination import drop_contaminated
from clerkwise.llm.frames import written
from clerkwise.llm.inputs import documents_and_labels, table, vocabulary
from clerkwise.llm.line_windows import drop_repeated_lines
from clerkwise.llm.near_duplicates import keep_one_of_each
from clerkwise.llm.packing import pack_documents
from clerkwise.llm.quality import fit_quality, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Learned from labelled rows among ``docs``. Equal texts go or stay together, so repeated rows do; null ids are judged like others, null and
    empty texts as empty. All columns pass through; an empty table gives no rows; without any label all rows stay.
    """
    _, labels = documents_and_labels(spark, sf_dir, "quality")
    return keep_good(docs, fit_quality(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines of repeated passages; those that lose every line go.

    Null and empty texts have no passage and stay. Rows that repeat id and text count as one document; rows of one id, null ids among
    them, are told apart by their texts. ``n_chars``, if there is such a column, follows the text; all others pass through, also those named like the
    operator's counts. An empty table gives no rows.
    """
    clashing = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    cut = drop_repeated_lines(docs.withColumnsRenamed(clashing)).where("n_removed < n_lines")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.drop("n_lines", "n_removed").withColumnsRenamed({own: c for c, own in clashing.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, null ids last, then the least text hash.

    Null and empty texts are in no group and stay; rows that repeat id and text stay once. All columns pass through; an empty table gives no rows.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Each row is judged by its text, whatever its id; null and empty texts stay. All columns pass through; an empty table gives no rows.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences.

    Null and empty texts are one piece of the end token; repeated rows and null ids are packed as often as they come. Only doc_id and text are
    read; an empty table gives no rows.
    """
    return pack_documents(docs, **vocabulary())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

# A trained classifier and a tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
