"""Document fingerprints by a randomised edit embedding.

One walk of 2n steps goes over each text of n characters. At every step all texts share a
random bit per character class; it says whether the walk stays at its character or goes on.
The characters met, step by step, are the embedding: after an edit two walks soon fall into
step again, so texts at a small edit distance differ in few steps. A fingerprint samples one
step for each of its places, the same steps for texts of like length, and keeps four bits of the
character met. Equal texts have equal fingerprints.

A text of more than 65 536 characters is walked in parts of as many, each from its own place: Python steps do not grow
with the longest text. An edit that moves the text by a few characters moves the start of every later part by as many, and each
part falls into step again as after any edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from clerkwise.llm.text_arrays import mix

PLACES = 128
STEPS = 2          # steps per character
PAD = 64           # class of the walk's steps behind the end of the text
PART_CHARS = 1 << 16  # a longer walk is set to its place in the text again after so many characters, and its parts go side by side
WALK_CHARS = 1 << 22
BLOCK_STEPS = 2048


def classes_of(text: str) -> np.ndarray:
    """Class 0 to 63 of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.uint8)


def _step_bits(steps: np.ndarray) -> np.ndarray:
    """The shared random bits of steps, one for each class."""
    return mix((steps + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _moves(first: int, count: int) -> np.ndarray:
    """For steps ``first`` onwards whether a walk at a character of each class goes on; on the pad it stays."""
    bits = _step_bits(np.arange(first, first + count))
    out = np.zeros((count, PAD + 1), dtype=np.int64)
    out[:, :PAD] = (bits[:, None] >> np.arange(PAD, dtype=np.uint64)) & np.uint64(1)
    return out


SYMBOL = (mix(np.arange(1, PAD + 2, dtype=np.uint64) * np.uint64(77)) >> np.uint64(60)).astype(np.uint8)


class Samples:
    """For each place of the fingerprint the steps that hold a record of its random order.

    A walk of s steps is sampled at the last record before s: the step that comes first in the
    place's order among the first s steps. Walks of nearly the same length share nearly all of them.
    """

    def __init__(self) -> None:
        self.reach = 0
        self.records: list[list[int]] = [[] for _ in range(PLACES)]
        self.least = np.full(PLACES, ~np.uint64(0), dtype=np.uint64)

    def extend(self, steps: int) -> None:
        while self.reach < steps:
            count = max(4096, min(1 << 16, self.reach))
            at = np.arange(self.reach, self.reach + count, dtype=np.uint64)
            for place in range(PLACES):
                order = mix(at * np.uint64(PLACES) + np.uint64(place + 1))
                low = np.minimum.accumulate(order)
                fresh = np.flatnonzero((order == low) & (order < self.least[place]))
                if len(fresh):
                    keep = [int(fresh[0]), *[int(i) for i in fresh[1:] if order[i] < low[i - 1]]]
                    self.records[place].extend(self.reach + i for i in keep)
                    self.least[place] = low[-1]
            self.reach += count

    def of(self, steps: np.ndarray) -> np.ndarray:
        """Sampled step of each place for walks of ``steps`` steps (at least 1)."""
        self.extend(int(steps.max()))
        out = np.empty((len(steps), PLACES), dtype=np.int64)
        for place, records in enumerate(self.records):
            records = np.array(records)
            out[:, place] = records[np.searchsorted(records, steps, "left") - 1]
        return out


def _lanes(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of all walks, those of most steps first: text, part of its walk, steps. A walk is cut every ``STEPS * PART_CHARS`` steps."""
    parts = -(-steps // (STEPS * PART_CHARS))
    owner = np.repeat(np.arange(len(steps)), parts)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    todo = np.minimum(steps[owner] - part * STEPS * PART_CHARS, STEPS * PART_CHARS)
    order = np.argsort(-todo, kind="stable")
    return owner[order], part[order], todo[order]


def fingerprints(texts: list[np.ndarray], samples: Samples) -> np.ndarray:
    """Fingerprint places (0 to 15) of texts given as class arrays; all walks, and the parts of long ones, advance together."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    steps = np.maximum(STEPS * length, 1)
    # Each text is followed by one pad, on which a walk that has left the text stays.
    flat = np.concatenate([x for t in texts for x in (t, np.full(1, PAD, np.uint8))])
    start = np.cumsum(length + 1) - (length + 1)
    owner, part, todo = _lanes(steps)
    lane = np.empty((len(texts), int(part.max()) + 1), dtype=np.int64)
    lane[owner, part] = np.arange(len(owner))
    # The sampled steps, in the order in which they are reached.
    wanted = samples.of(steps)
    inside = (wanted % (STEPS * PART_CHARS)).reshape(-1)
    order = np.argsort(inside, kind="stable")
    inside, lanes = inside[order], lane[np.arange(len(texts))[:, None], wanted // (STEPS * PART_CHARS)].reshape(-1)[order]
    symbols = np.empty(len(order), dtype=np.uint8)
    at = start[owner] + part * PART_CHARS
    total = int(todo[0])
    # How many lanes are still going at each step.
    active = np.searchsorted(-todo, -np.arange(total), "left")
    long = bool(part.any())
    for a in range(0, total, BLOCK_STEPS):
        count = min(BLOCK_STEPS, total - a)
        begin = np.concatenate([[0], np.cumsum(active[a:a + count])])
        met = np.empty(int(begin[-1]), dtype=np.uint8)
        moves = _moves(a, count)
        words = _step_bits(a + np.arange(part.max() + 1)[:, None] * STEPS * PART_CHARS + np.arange(count)) if long else None
        for j in range(count):
            n, to = active[a + j], begin[j]
            here = met[to:to + n]
            np.take(flat, at[:n], out=here, mode="clip")
            if long:
                at[:n] += ((words[part[:n], j] >> (here & 63)) & np.uint64(1)).astype(np.int64) * (here < PAD)
            else:
                at[:n] += np.take(moves[j], here, mode="clip")
        now = slice(*np.searchsorted(inside, [a, a + count]))
        symbols[order[now]] = SYMBOL[met[begin[inside[now] - a] + lanes[now]]]
    return symbols.reshape(len(texts), PLACES)


def as_text(places: np.ndarray) -> list[str]:
    return [bytes(row[::2] << 4 | row[1::2]).hex() for row in places]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, freed of the share that chance gives (one in 16); 0 to 1."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 16) / (1 - 1 / 16), 0.0, 1.0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows (doc_id, bucket, ends, text) of one bucket, bounded in size; a run starts with the last row of the run before."""
    run: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "bucket", "ends", "text")], strict=True):
            if run and run[-1][1] != row[1]:
                run, size = [], 0
            run.append(row)
            size += len(row[3])
            if row[2] or size > WALK_CHARS:
                yield run
                run, size = ([], 0) if row[2] else ([row], len(row[3]))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending order of doc_id; after the last document comes the
    first. One row per row of ``documents``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited and near_next (0 to 1).

    Null texts count as empty. Null ids come last; rows of one id are ordered by a hash of their
    text, so repeated rows follow each other. Other columns are ignored; an empty table gives no
    rows. The texts are shuffled once, by ranges of ids; only the first document of each range
    is sent to another one.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    # Bounds of the ranges from ids of a sample, 16 for each range.
    ids = documents.select("doc_id").where("doc_id is not null")
    sample = sorted((r[0] for r in ids.orderBy(F.xxhash64("doc_id")).limit(16 * ranges).collect()), reverse=True)
    bounds = spark.sparkContext.broadcast(sorted(set(sample[16::16])))

    def bucketed(frame: DataFrame) -> DataFrame:
        from bisect import bisect_right

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                n = len(bounds.value)
                found = [n + 1 if i is None else n - bisect_right(bounds.value, i) for i in part.column("doc_id").to_pylist()]
                yield part.append_column("bucket", pa.array(found, pa.int32()))

        return frame.mapInArrow(run, StructType([*frame.schema.fields]).add("bucket", "integer"))

    # The first document of each range that has any follows the last one of the range before.
    firsts = sorted((r["bucket"], r["first"]) for r in bucketed(docs.select("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    follow = [(firsts[k][0], firsts[(k + 1) % len(firsts)][1]) for k in range(len(firsts))]
    after = spark.createDataFrame(follow, StructType().add("bucket", "integer").add("doc_id", kind))
    # One row a range, so this side is bounded by the number of ranges.
    fetched = (docs.join(F.broadcast(after.withColumnRenamed("doc_id", "id")), F.col("doc_id").eqNullSafe(F.col("id")))
               .groupBy("bucket", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")))
    ends = fetched.select("doc_id", F.col("least.text").alias("text"), "bucket", F.lit(True).alias("ends"))
    rows = bucketed(docs).select("doc_id", "text", "bucket", F.lit(False).alias("ends")).unionByName(ends)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ends", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    # Made once for texts of up to 100,000 characters; a task with a longer one goes on from there.
    samples = Samples()
    samples.extend(STEPS * 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pairs(batches):
            texts = [r[3] for r in rows]
            edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
            if not edited:
                continue
            own = fingerprints([classes_of(t) for t in texts], samples)
            other = fingerprints([classes_of(t) for t in edited], samples)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows[:-1]], id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                 pa.array(as_text(own[:-1])), pa.array(as_text(other)),
                 pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    id_type = to_arrow_type(kind)
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
