"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; all other training texts count as unlabelled. A
linear model over the presence of words is trained on the risk
``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``: the unlabelled texts
stand for a mixture, from which the positive share is taken off, and the correction may not
push the negative risk below zero. Where it does, the step undoes the overfit instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import bounded_sample, map_texts
from clerkwise.llm.text_arrays import (
    ALNUM,
    LOWER_CODES,
    Powers,
    _random_table,
    ascii_lower,
    mix,
    span_hashes,
    text_bytes,
    word_spans,
)

SLOTS = 1 << 20
PREFIXES = (4, 5, 6)
PREFIX_CODES = [_random_table(256, 200 + n)[ascii_lower()] for n in range(max(PREFIXES))]


@dataclass(frozen=True)
class ToxicityModel:
    slots: np.ndarray    # the word slots the model looks at, sorted
    weights: np.ndarray
    bias: float


def word_slots(part: pa.RecordBatch, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words and word beginnings, and the row of each.

    Insults are inflected, so the first 4, 5 and 6 bytes of longer words count as words too.
    """
    data, offsets = text_bytes(part.column("text"))
    starts, ends, edge = word_spans(data, offsets, ALNUM)
    row = np.repeat(np.arange(part.num_rows), np.diff(edge))
    found, rows = [span_hashes(data, starts, ends, powers, LOWER_CODES)], [row]
    total = np.zeros(len(starts), dtype=np.uint64)
    for n, codes in enumerate(PREFIX_CODES):
        long = ends - starts > n
        starts, ends, row, total = starts[long], ends[long], row[long], total[long]
        total = total + codes[data[starts + n]]
        if n + 1 in PREFIXES:
            found.append(mix(total))
            rows.append(row)
    return (np.concatenate(found) >> np.uint64(44)).astype(np.int64), np.concatenate(rows)


def fit_toxicity(documents: DataFrame, labels: DataFrame, positives: int = 2500, unlabelled: int = 6000, words: int = 800,
                 prior: float | None = None, steps: int = 400, pool: DataFrame | None = None) -> ToxicityModel:
    """Train on texts (doc_id, text) with labels (doc_id, toxic) that may be read.

    ``positives`` and ``unlabelled`` bound the training sample; ids with the lowest hashes are
    taken. The unlabelled texts are drawn from ``pool`` (doc_id), by default the rows of ``labels``; their labels are not looked at.
    ``prior`` is the share of toxic texts in the pool; by default the share among the labelled rows, so give both or neither.
    Without a confirmed toxic text every text scores 0. Null ids are not learned from; a null text counts as empty; of an id's labels the
    greatest counts, and of rows that repeat an id one text (that of the least word slots); other columns are ignored.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -8.0)
    prior = min(max(prior or toxic / n, 1e-4), 0.9)
    unseen = labels.select("doc_id") if pool is None else pool.where("doc_id is not null").select("doc_id").distinct()
    chosen = (bounded_sample(labels.where("toxic = 1").select("doc_id"), positives).withColumn("role", F.lit(1))
              .union(bounded_sample(unseen, unlabelled).withColumn("role", F.lit(0))))
    # Both samples are bounded by their row counts, so this side may be lent to every task.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def slots(part: pa.RecordBatch) -> pa.RecordBatch:
        found, row = word_slots(part, Powers())
        once = np.unique(row * SLOTS + found)
        edge = np.searchsorted(once, np.arange(part.num_rows + 1) * SLOTS)
        lists = [(once[a:b] % SLOTS).astype("<u4").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("role"), pa.array(lists, pa.binary())], ["doc_id", "role", "slots"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = map_texts(rows, slots, f"doc_id {kind}, role int, slots binary").groupBy("doc_id", "role").agg(F.min("slots").alias("slots"))
    sample = sorted((r["role"], bytes(r["slots"])) for r in found.select("role", "slots").collect())
    role = np.array([r for r, _ in sample])
    texts = [np.frombuffer(b, "<u4").astype(np.int64) for _, b in sample]
    df = {k: np.bincount(np.concatenate([t for t, r in zip(texts, role, strict=True) if r == k] or [np.zeros(0, np.int64)]), minlength=SLOTS) for k in (0, 1)}
    share = {k: (df[k] + 0.5) / (np.sum(role == k) + 1.0) for k in (0, 1)}
    # Words whose share among the positives stands out; a word of few positives tells nothing.
    lift = np.where((df[1] >= max(3, 0.002 * np.sum(role == 1))) & (share[1] > 2 * share[0]), share[1] * np.log(share[1] / share[0]), 0.0)
    order = np.argsort(-lift, kind="stable")[:words]
    chosen_slots = np.sort(order[lift[order] > 0.005])
    x = np.zeros((len(texts), len(chosen_slots)), dtype=np.float32)
    for i, t in enumerate(texts):
        x[i, np.isin(chosen_slots, t, assume_unique=True)] = 1
    weights, bias = train(x[role == 1], x[role == 0], prior, steps)
    return ToxicityModel(chosen_slots, weights, bias)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, rate: float = 0.1,
          decay: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss."""
    theta = np.zeros(positive.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def chance(x):
        return 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -30, 30)))

    def pull(x, residual):
        return np.append(x.T @ residual, residual.sum()) / max(len(x), 1)

    for step in range(1, steps + 1):
        p, u = chance(positive), chance(unlabelled)
        loss_p, loss_u = -np.log1p(-p + 1e-12).mean(), -np.log1p(-u + 1e-12).mean()
        negative = pull(unlabelled, u) - prior * pull(positive, p)
        if loss_u - prior * loss_p < -slack:
            gradient = -negative
        else:
            gradient = prior * pull(positive, p - 1) + negative
        gradient[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1].copy(), float(theta[-1])


def score_toxicity(documents: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) for each row.

    Whole texts are read. A null or empty text gets the score of a text without any known word.
    Other input columns are ignored, so their names cannot clash; repeated rows give repeated
    results; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.slots, model.weights, model.bias))
    columns = [f for f in documents.schema.fields if f.name in keep]
    powers = []

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        slots, weights, bias = shared.value
        if not powers:
            powers.append(Powers())
        found, row = word_slots(part, powers[0])
        value = np.full(part.num_rows, bias)
        if len(slots):
            place = np.minimum(np.searchsorted(slots, found), len(slots) - 1)
            hit = np.flatnonzero(slots[place] == found)
            once = np.unique(row[hit] * len(slots) + place[hit])
            np.add.at(value, once // len(slots), weights[once % len(slots)])
        chance = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
        return pa.RecordBatch.from_arrays(
            [*[part.column(f.name) for f in columns], pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))],
            [*[f.name for f in columns], "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["score double", "predicted int"])
    return map_texts(documents.select(*[f.name for f in columns], "text"), score, schema)
