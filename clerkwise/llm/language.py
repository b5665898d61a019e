"""Language identification with a blended-spectrum presence kernel.

k(x, y) counts the n-grams (1 to 4 bytes of the lower-cased UTF-8 text) that two texts share,
each counted once, divided by the geometric mean of their n-gram counts. A few labelled texts
serve as landmarks (Nystroem); one-versus-rest kernel ridge regression gives a weight per
landmark and language. Because the kernel is a dot product of presence vectors, landmarks and
weights fold into one matrix, and a block of texts is scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import map_texts
from clerkwise.llm.text_arrays import _random_table, byte_set, text_bytes

ORDERS = 4
DIMS = 1 << 16
BLOCK = 32

LETTER = byte_set(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
GRAM_CODES = [_random_table(256, 100 + n) for n in range(ORDERS)]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # DIMS x languages


def gram_slots(text: np.ndarray) -> list[np.ndarray]:
    """Slots of all n-grams of one text, one array for each order."""
    out, total = [], np.zeros(len(text), dtype=np.uint64)
    for n in range(ORDERS):
        if len(text) <= n:
            break
        # A different table for each place makes the sum depend on the order of the bytes.
        total = total[:len(text) - n] + GRAM_CODES[n][text[n:]]
        out.append((total * np.uint64(0x9E3779B97F4A7C15 + 2 * n) >> np.uint64(48)).astype(np.int64))
    return out


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def presence(first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence rows of the texts ``first`` to ``last``; a long text is read in pieces."""
    block = np.zeros((last - first, DIMS), dtype=np.float32)
    for row in range(first, last):
        a, b = int(offsets[row]), int(offsets[row + 1])
        for start in range(a, b, 1 << 18):
            for slots in gram_slots(data[start:min(start + (1 << 18) + ORDERS - 1, b)]):
                block[row - first, slots] = 1
    return block


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    count = np.concatenate([[0], np.cumsum(LETTER[data])])
    found = count[offsets[1:]] > count[offsets[:-1]]
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~found & (wide[offsets[1:]] > wide[offsets[:-1]])):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def fit_language(documents: DataFrame, per_language: int = 400, landmarks_per_language: int = 64,
                 ridge: float = 1e-2, most_languages: int = 256, most_texts: int = 8000, most_landmarks: int = 512) -> LanguageModel:
    """Train on rows (doc_id, text, lang); rows with a null in these are left out, and the caller leaves out what must not be learned.

    At most ``per_language`` texts of each language, those whose id hashes lowest, are used, and
    of each text only the occupied n-gram slots reach the driver. Of more than ``most_languages`` languages the most frequent are
    learned (ties by name); with many languages each has fewer texts and landmarks, so that there are about ``most_texts`` and
    ``most_landmarks`` of them (256 KB a landmark) whatever the table holds. Of rows that repeat an id and a language one text is learned from; an empty table gives a model
    that knows no language.
    """
    rows = documents.where("doc_id is not null and text is not null and lang is not null")
    frequent = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), np.zeros((DIMS, 0), np.float32))
    per_language = max(1, min(per_language, most_texts // len(languages)))
    landmarks_per_language = max(1, min(landmarks_per_language, most_landmarks // len(languages)))
    # Every language keeps the ids below a threshold of its own; the few too many are cut on arrival.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_language / n)))])
    place = (F.xxhash64("doc_id") / F.lit(float(1 << 63)) + 1) / 2
    picked = rows.select("doc_id", "text", "lang", place.alias("place")).where(place <= F.element_at(share, F.col("lang")))

    def slots(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _lowered(part.column("text"))
        found = [np.flatnonzero(presence(i, i + 1, data, offsets)[0]).astype("<u2").tobytes() for i in range(part.num_rows)]
        return pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array(found, pa.binary())],
                                          ["lang", "place", "slots"])

    sample = map_texts(picked, slots, "lang string, place double, slots binary").groupBy("lang", "place").agg(F.min("slots").alias("slots")).collect()
    by_language = {k: sorted((r["place"], bytes(r["slots"])) for r in sample if r["lang"] == k)[:per_language] for k in languages}
    texts = [(np.frombuffer(b, "<u2"), j) for j, k in enumerate(languages) for _, b in by_language[k] if b]
    marks = [s for j, k in enumerate(languages) for s in [np.frombuffer(b, "<u2") for _, b in by_language[k] if b][:landmarks_per_language]]
    basis = np.zeros((DIMS, len(marks)), dtype=np.float32)
    for i, s in enumerate(marks):
        basis[s, i] = 1 / np.sqrt(len(s))
    cross = np.array([basis[s].sum(axis=0) / np.sqrt(len(s)) for s, _ in texts], dtype=np.float64)
    target = np.where(np.array([j for _, j in texts])[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Languages count alike, however many texts each has.
    weight = 1 / np.bincount([j for _, j in texts], minlength=len(languages))[[j for _, j in texts]]
    inner = basis.T.astype(np.float64) @ basis
    left = cross.T @ (cross * weight[:, None]) + ridge * inner + 1e-6 * np.eye(len(marks))
    alpha = np.linalg.solve(left, cross.T @ (target * weight[:, None]))
    return LanguageModel(languages, (basis @ alpha).astype(np.float32))


def identify_language(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (softmax of the regression values) for each row.

    Whole texts are read. ``und`` with score 0.0 for a null text, a text without a letter, or
    a model that has learned no language. Other columns of the input are ignored, so their
    names cannot clash; repeated rows give repeated results; an empty table gives none.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.weights))
    columns = [f for f in documents.schema.fields if f.name in keep]

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        languages, weights = shared.value
        text = part.column("text")
        known = has_letter(text) & bool(languages)
        data, offsets = _lowered(text)
        best, sure = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows)
        for a in range(0, part.num_rows if languages else 0, BLOCK):
            b = min(a + BLOCK, part.num_rows)
            block = presence(a, b, data, offsets)
            value = (block @ weights) / np.sqrt(np.maximum(block.sum(axis=1), 1))[:, None]
            chance = np.exp(4 * (value - value.max(axis=1, keepdims=True)))
            best[a:b], sure[a:b] = value.argmax(axis=1), 1 / chance.sum(axis=1)
        names = [languages[j] if ok else "und" for j, ok in zip(best, known, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*[part.column(f.name) for f in columns], pa.array(names, pa.string()), pa.array(np.where(known, sure, 0.0))],
            [*[f.name for f in columns], "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["lang_pred string", "score double"])
    return map_texts(documents.select(*[f.name for f in columns], "text"), score, schema)
