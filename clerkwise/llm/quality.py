"""Text quality: ridge regression on random Fourier features of document statistics.

Each text becomes a short vector of statistics. Random cosines of these (a Gaussian kernel in
expectation) feed a ridge regression whose normal equations are summed by partition; a monotone
step function, fitted by pooling adjacent violators over score bins, turns the regression
value into the share of good texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import bounded_sample, map_texts
from clerkwise.llm.text_arrays import LOWER_CODES, SPACED, Powers, byte_set, span_hashes, text_bytes, word_spans

UPPER = byte_set(lambda b: 65 <= b <= 90)
LETTER = byte_set(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
DIGIT = byte_set(lambda b: 48 <= b <= 57)
STOP = byte_set(lambda b: b in b".,;:?'\"-")
SHOUT = byte_set(lambda b: b == 33)
ODD = byte_set(lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~")
BAR = byte_set(lambda b: b in b"|")
BREAK = byte_set(lambda b: b == 10)
END = byte_set(lambda b: b in b".?!")

STATISTICS = ["log_words", "word_bytes", "upper", "letters", "digits", "stops", "shouts", "odd", "bars", "breaks", "ends",
              "distinct_words", "distinct_pairs", "top_word", "long_words", "short_words", "no_letter_words", "capital_words",
              "distinct_lines", "empty"]


def statistics(part: pa.RecordBatch, powers: Powers) -> np.ndarray:
    """One row of statistics for each text, every one of the whole text and within a fixed range."""
    data, offsets = text_bytes(part.column("text"))
    starts, ends, edge = word_spans(data, offsets, SPACED)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words = np.maximum(np.diff(edge), 1).astype(float)

    def per_byte(table):
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]), total

    def per_word(flag):
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[edge[1:]] - total[edge[:-1]]) / words

    length = ends - starts
    hashes = span_hashes(data, starts, ends, powers, LOWER_CODES)
    letters, letter_total = per_byte(LETTER)
    upper, upper_total = per_byte(UPPER)
    distinct, pairs, top, lines = (np.ones(part.num_rows) for _ in range(4))
    line_starts, line_ends, line_edge = word_spans(data, offsets, ~BREAK)
    line_hashes = span_hashes(data, line_starts, line_ends, powers)
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if b > a:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            distinct[i], top[i] = len(counts) / (b - a), counts.max() / (b - a)
        if b > a + 1:
            pairs[i] = len(np.unique(hashes[a:b - 1] * np.uint64(3) + hashes[a + 1:b])) / (b - a - 1)
        x, y = line_edge[i], line_edge[i + 1]
        if y > x:
            lines[i] = len(np.unique(line_hashes[x:y])) / (y - x)
    word_letters = letter_total[ends] - letter_total[starts]
    word_upper = upper_total[ends] - upper_total[starts]
    columns = [
        np.log1p(np.diff(edge)) / 10, np.minimum(np.diff(offsets) / words, 30) / 30, upper / size, letters / size,
        per_byte(DIGIT)[0] / size, per_byte(STOP)[0] / size, per_byte(SHOUT)[0] / words, per_byte(ODD)[0] / words,
        per_byte(BAR)[0] / words, per_byte(BREAK)[0] / words, per_byte(END)[0] / words, distinct, pairs, top,
        per_word(length > 15), per_word(length <= 2), per_word(word_letters == 0), per_word(word_upper > 0), lines,
        (np.diff(edge) == 0).astype(float),
    ]
    return np.minimum(np.stack(columns, axis=1), 3.0)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray    # statistics x features
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray    # regression values where the calibrated score changes
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        wave = np.cos(((stats - self.mean) / self.scale) @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([wave, np.ones((len(stats), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(stats), 0.5)
        # Rounded, since a row's last bits depend on the rows it is multiplied with.
        return np.round(np.interp(np.round(self.features(stats) @ self.weights, 9), self.steps, self.levels), 9)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit."""
    out: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            w2 = a[1] + b[1]
            out.append([(a[0] * a[1] + b[0] * b[1]) / w2, w2, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in out]) if out else np.zeros(0)


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = 60000, features: int = 192, width: float = 3.0,
                ridge: float = 1e-3, bins: int = 400, seed: int = 8) -> QualityModel:
    """Train on texts (doc_id, text) with labels (doc_id, quality) that may be read.

    ``rows`` bounds the labelled rows that are used (ids with the lowest hashes). Sums for the
    scaling, the normal equations and the calibration bins are made by partition; what reaches
    the driver is a few matrices of ``features`` squared per partition of the sample. Null ids and labels are not learned from; of an id's
    labels the greatest counts, and of rows that repeat an id one text (that of the least statistics); a null text counts as empty; other columns are
    ignored; without any label the model scores 0.5.
    """
    spark = documents.sparkSession
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = bounded_sample(labels, rows)
    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    width_of = len(STATISTICS)

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        stats = statistics(part, Powers())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(stats.reshape(-1)), width_of).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), lists], ["doc_id", "quality", "stats"])

    # A few numbers for each labelled id, at most ``rows`` of them: read once, used three times.
    kind = documents.schema["doc_id"].dataType.simpleString()
    known = (map_texts(joined, measure, f"doc_id {kind}, quality int, stats array<double>").groupBy("doc_id", "quality").agg(F.min("stats").alias("stats"))
             .select("quality", "stats").repartition(8).persist())

    def summed(make, shape):
        """Element-wise sum of ``make(quality, stats)`` over all rows, one partial sum a partition."""
        def work(batches):
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
                    total += make(batch.column("quality").to_numpy(zero_copy_only=False), flat.reshape(-1, width_of))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])
        found = known.mapInArrow(work, "total binary").collect()
        return sum((np.frombuffer(bytes(r["total"])).reshape(shape) for r in found), np.zeros(shape))

    try:
        moments = summed(lambda y, s: np.stack([np.full(width_of, len(y)), s.sum(axis=0), (s ** 2).sum(axis=0)]), (3, width_of))
        n = moments[0, 0]
        empty = np.zeros(0)
        if not n:
            return QualityModel(np.zeros(width_of), np.ones(width_of), np.zeros((width_of, 1)), np.zeros(1), np.zeros(2), empty, empty)
        mean = moments[1] / n
        spread = np.sqrt(np.maximum(moments[2] / n - mean ** 2, 0))
        random = np.random.default_rng(seed)
        model = QualityModel(mean, np.maximum(spread, 0.02), random.normal(size=(width_of, features)) / width,
                             random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), empty, empty)

        def normal(y, s):
            z = model.features(s)
            return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

        sums = summed(normal, (features + 1, features + 2))
        weights = np.linalg.solve(sums[:, :-1] + ridge * n / features * np.eye(features + 1), sums[:, -1])

        def binned(y, s):
            place = np.clip((model.features(s) @ weights + 0.5) / 2 * bins, 0, bins - 1).astype(int)
            return np.stack([np.bincount(place, minlength=bins), np.bincount(place, weights=y, minlength=bins)]).astype(float)

        counts = summed(binned, (2, bins))
    finally:
        known.unpersist()
    used = np.flatnonzero(counts[0])
    level = pool_adjacent(counts[1, used] / counts[0, used], counts[0, used])
    steps = (used + 0.5) / bins * 2 - 0.5
    return QualityModel(model.mean, model.scale, model.waves, model.phases, weights, steps, np.clip(level, 0, 1))


def score_quality(documents: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) for each row.

    A null text counts as empty and is scored by its statistics like any other. Other input
    columns are ignored, so their names cannot clash; repeated rows give repeated results; an
    empty table gives none. A model without any label scores 0.5.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    columns = [f for f in documents.schema.fields if f.name in keep]
    powers = []

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        if not powers:
            powers.append(Powers())
        value = QualityModel(**shared.value).score(statistics(part, powers[0]))
        return pa.RecordBatch.from_arrays(
            [*[part.column(f.name) for f in columns], pa.array(value), pa.array((value >= threshold).astype(np.int32))],
            [*[f.name for f in columns], "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["score double", "predicted int"])
    return map_texts(documents.select(*[f.name for f in columns], "text"), score, schema)


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose score reaches ``threshold``.

    Only the text decides: null ids make no difference, a null text counts as empty, equal texts go or stay together. Columns of any
    other names pass through; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    powers = []

    def good(part: pa.RecordBatch) -> pa.RecordBatch:
        if not powers:
            powers.append(Powers())
        return part.filter(pa.array(QualityModel(**shared.value).score(statistics(part, powers[0])) >= threshold))

    return map_texts(documents, good, documents.schema)
