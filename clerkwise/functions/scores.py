"""Confidence, review flag and urgency."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_THRESHOLD = 0.82

# Words that make a document urgent.
URGENT_WORDS = (
    "urgent",
    "immediate",
    "emergency",
    "deadline",
    "hearing date",
    "time sensitive",
)


def classification_confidence(hits: Column, keywords: Column) -> Column:
    """Score of the best rule from its hit count and keyword count."""
    ratio = hits / F.greatest(keywords, F.lit(1))
    score = (
        F.when(hits == 0, F.lit(0.45))
        .when(hits == 1, F.lit(0.65) + ratio * 0.08)
        .when(hits == 2, F.lit(0.78) + ratio * 0.08)
        .otherwise(F.lit(0.86) + F.least((hits - 3) * 0.03, F.lit(0.1)))
    )
    return F.round(F.least(score, F.lit(0.99)), 4)


def penalised_confidence(classified: Column, extracted: Column, errors: Column) -> Column:
    """Weaker of both confidences less a capped penalty per validation error (unrounded)."""
    penalty = F.least(errors * 0.08, F.lit(0.35))
    return F.greatest(F.least(classified, extracted) - penalty, F.lit(0.0))


def needs_review(confidence: Column, errors: Column, doc_type: Column,
                 threshold: float = REVIEW_THRESHOLD, forced: Iterable[str] = ()) -> Column:
    flag = (confidence < F.lit(threshold)) | (errors > 0)
    forced = [item.lower() for item in forced]
    return flag | F.lower(doc_type).isin(*forced) if forced else flag


def urgency(lowered_text: Column) -> Column:
    found = F.lit(False)
    for word in URGENT_WORDS:
        found = found | F.contains(lowered_text, F.lit(word))
    return F.when(found, F.lit("high")).otherwise(F.lit("normal"))


def clamp_confidence(col: Column) -> Column:
    """Missing counts as 0; kept within 0..0.99; four decimals."""
    value = F.coalesce(col, F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(value, F.lit(0.99))), 4)
