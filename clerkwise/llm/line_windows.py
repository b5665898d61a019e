"""Removal of repeated passages of three lines, with DataFrame functions only.

Three consecutive lines make a window; windows overlap. Of equal windows anywhere in the table
the first one, in order of document id and place, stays; every line that a later one covers
goes. Windows are judged on the texts as they came, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, the hash of the text (tells rows of one id apart) and the text's lines; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))


def _windows(lines: DataFrame) -> DataFrame:
    """One row per window: its 128-bit hash, its document and its first line."""
    triple = F.arrays_zip(F.col("lines").alias("a"), F.slice("lines", 2, F.size("lines")).alias("b"),
                          F.slice("lines", 3, F.size("lines")).alias("c"))
    whole = F.slice(triple, 1, F.greatest(F.size("lines") - 2, F.lit(0)))
    hashed = F.transform(whole, lambda w: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h1"),
                                                   F.xxhash64(F.lit(1), w["a"], w["b"], w["c"]).alias("h2")))
    return (lines.select("doc_id", "text_hash", F.posexplode(hashed).alias("place", "w"))
            .select("w.h1", "w.h2", "doc_id", "text_hash", "place"))


def line_cuts(documents: DataFrame) -> DataFrame:
    """For each document with lines to remove: doc_id, text_hash and the windows that go (``cuts``)."""
    windows = _windows(_lines(documents))
    # Counted and ordered before the shuffle, so a window that is everywhere costs one row a task.
    repeated = (windows.groupBy("h1", "h2")
                .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "text_hash", "place")).alias("first"))
                .where("times > 1").select("h1", "h2", "first"))
    later = windows.join(repeated, ["h1", "h2"]).where(F.struct("doc_id", "text_hash", "place") != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("cuts"))


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` (doc_id, text and others) with ``text`` less the repeated lines,
    and ``n_lines`` and ``n_removed``.

    A null or empty text has one empty line and nothing to remove; texts of fewer than three lines
    have no window. Rows that repeat both id and text count as one document and are all kept
    alike; rows of one id with different texts, null ids among them, are told apart by the text.
    Input columns named n_lines or n_removed are replaced. An empty table gives none.
    """
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", *others, F.col("text").isNull().alias("__null"), F.xxhash64(text).alias("__hash"),
                            F.split(text, "\n").alias("__lines"))
    cuts = line_cuts(documents).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text_hash"), "cuts")
    joined = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text_hash")), "left")
    covered = F.flatten(F.transform("cuts", lambda p: F.array(p, p + 1, p + 2)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), covered)
    # Places, not lines, are compared: the lines come whole through the join and are picked by place.
    left = F.when(F.col("cuts").isNull(), F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n"))
    removed = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))
    out = joined.select("doc_id", F.when(~F.col("__null"), left).alias("text"), *others,
                        F.size("__lines").cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"))
    return out.select(*[c for c in documents.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
