"""Hard negatives by exact integer scores from a residue number system.

Components are whole numbers. Their matrices are reduced modulo several small primes and multiplied in
float32, where no partial sum passes 2^24 and all are therefore exact; the Chinese remainder theorem puts the
signed score together again. Anchors come in blocks of bounded size, each sent to all tasks; a task
walks its rows in tiles and keeps only what may still be among the first of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clerkwise.llm.frames import written
from clerkwise.session import number_rows

EXACT = 1 << 24       # float32 holds all whole numbers up to here
DEPTH = 64            # components multiplied at once
TILE = 4096           # rows scored at once
ANCHORS = 512         # anchors scored at once
BLOCK = 16384         # anchors sent out at once
MOST = 1 << 59        # scores must stay below
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def primes(bound: int) -> list[int]:
    """Small primes, greatest first, whose product exceeds four times ``bound``; residues lie around zero, so sums of ``DEPTH`` products stay exact."""
    out: list[int] = []
    product, p = 1, 2 * int((EXACT // DEPTH) ** 0.5)
    while product <= 4 * bound:
        p -= 1
        if p < 3:
            raise ValueError("scores too large")
        if p % 2 and all(p % d for d in range(3, int(p ** 0.5) + 1, 2)):
            out.append(p)
            product *= p
    return out


def residues(components: np.ndarray, modulus: int) -> np.ndarray:
    """Residues in -(p-1)/2 .. (p-1)/2 as float32."""
    half = modulus // 2
    return (np.mod(components + half, modulus) - half).astype(np.float32)


def products(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Inner products of all rows of ``left`` with all of ``right``, given their residues for each modulus."""
    digits: list[np.ndarray] = []
    value = weight = None
    for k, p in enumerate(moduli):
        total = np.zeros((len(left[k]), len(right[k])), dtype=np.int32)
        for a in range(0, left[k].shape[1], DEPTH):
            total = (total + (left[k][:, a:a + DEPTH] @ right[k][:, a:a + DEPTH].T).astype(np.int32)) % np.int32(p)
        # The next digit in the mixed radix of the primes so far.
        for digit, q in zip(digits, moduli, strict=False):
            total = (total - digit) * np.int32(pow(q, -1, p)) % np.int32(p)
        digits.append(total)
        step = 1 if weight is None else weight * moduli[k - 1]
        part = total.astype(np.uint64) * np.uint64(step % (1 << 64))
        value = part if value is None else value + part
        weight = step
    # The product of the primes is more than four times any score, so the leading digits tell the sign.
    whole = weight * moduli[-1]
    height = sum(d.astype(np.float64) * (w / whole) for d, w in zip(digits[-3:], _weights(moduli)[-3:], strict=True))
    return np.where(height > 0.5, value - np.uint64(whole % (1 << 64)), value).view(np.int64)


def _weights(moduli: list[int]) -> list[int]:
    out = [1]
    for p in moduli[:-1]:
        out.append(out[-1] * p)
    return out


def first_of_rows(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` greatest allowed scores of each row, and of all that equal the last of them."""
    least = np.iinfo(np.int64).min
    held = np.where(allowed, scores, least)
    if held.shape[1] > count:
        last = np.partition(held, held.shape[1] - count, axis=1)[:, held.shape[1] - count]
        return np.nonzero(allowed & (held >= last[:, None]))
    return np.nonzero(allowed)


class Best:
    """The first ``count`` candidates of each slot so far: greater scores first, ties by smaller id, null ids last."""

    def __init__(self, count: int) -> None:
        self.count = count
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def add(self, found: list[tuple]) -> None:
        """``found``: tuples (slot, score, id, whether the id is null) of arrays."""
        if not found:
            return
        slot, score, name, null = (np.concatenate([h, *parts]) for h, parts in zip(self.held, zip(*found, strict=True), strict=True))
        order = np.lexsort((name, null, -score, slot))
        slot = slot[order]
        start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        keep = order[rank < self.count]
        self.held = [slot[rank < self.count], score[keep], name[keep], null[keep]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        slot, score, name, null = self.held
        for a in range(0, len(slot), 1 << 16):
            b = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(slot[b]), pa.array(score[b]), pa.array(name[b], mask=null[b])], ["slot", "score", "vec_id"])


FOUND = "slot bigint, score bigint, vec_id bigint"


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Whole components of vectors without nulls; missing ones count as zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < length[:, None]] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64)
    return out


def _tiles(batches: Iterator[pa.RecordBatch], width: int, scale: int, moduli: list[int]):
    """Residues, labels and ids of the rows, a tile at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, TILE):
            part = batch.slice(a, TILE)
            name = part.column("vec_id")
            components = matrix(part.column("vector"), width, scale)
            yield ([residues(components, p) for p in moduli], part.column("label").to_numpy(zero_copy_only=False),
                   name.fill_null(0).to_numpy(zero_copy_only=False), name.is_null().to_numpy(zero_copy_only=False))


def _positives(shared, width: int, scale: int, moduli: list[int], count: int):
    """For each anchor the first rows of its label, itself among them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, anchor_label = shared.value["residues"], shared.value["label"]
        best = Best(count + 1)
        for right, label, name, null in _tiles(batches, width, scale, moduli):
            found = []
            for x in np.unique(label):
                of_label = np.flatnonzero(anchor_label == x)
                rows = np.flatnonzero(label == x)
                for a in range(0, len(of_label), ANCHORS):
                    mine = of_label[a:a + ANCHORS]
                    scores = products([m[mine] for m in left], [m[rows] for m in right], moduli)
                    i, j = first_of_rows(scores, np.ones(scores.shape, bool), count + 1)
                    found.append((mine[i], scores[i, j], name[rows[j]], null[rows[j]]))
            best.add(found)
        yield from best.batches()

    return work


def _negatives(shared, width: int, scale: int, moduli: list[int], count: int):
    """For each slot (an anchor and one of its positives) the first rows of other labels inside its window of scores."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, anchor_label, low, high = (shared.value[k] for k in ("residues", "label", "low", "high"))
        slots = low.shape[1]
        best = Best(count)
        for right, label, name, null in _tiles(batches, width, scale, moduli):
            found = []
            for a in range(0, len(anchor_label), ANCHORS):
                b = slice(a, a + ANCHORS)
                scores = products([m[b] for m in left], right, moduli)
                other = anchor_label[b][:, None] != label[None, :]
                for k in range(slots):
                    inside = other & (scores >= low[b, k, None]) & (scores <= high[b, k, None])
                    i, j = first_of_rows(scores, inside, count)
                    found.append(((a + i) * slots + k, scores[i, j], name[j], null[j]))
            best.add(found)
        yield from best.batches()

    return work


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = W.partitionBy("slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        scale: int = 256, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the anchors among all rows of ``vectors`` (vec_id, label, embedding).

    Each component x becomes floor(scale * x) and the score of two rows is their inner product. An anchor's positives are its
    first ``positives`` other rows of the same label. For each of them, the first ``negatives`` rows of another label whose score is
    at least ``low`` and at most ``high`` per cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Greater scores come first, ties by smaller vec_id, null ids last. Fewer are returned where there are fewer.

    Rows with a null label, a null vector or any null or non-finite component take no part. Vectors may differ in length: missing components
    count as zero. Rows are judged one by one, so repeated rows and ids are rows of their own; a null id is no anchor unless
    ``is_anchor`` says so. Other columns are ignored; an empty table or one without anchors gives no rows. Scores that may
    reach 2^59 raise an error, since they would not be exact.

    ``is_anchor`` is a stated set of queries: every block of at most ``block`` anchors visits all rows twice. Memory depends on the block, not the table.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").cast("array<double>")
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"),
                    F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    longest = F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x * scale).cast("double"))))
    width, greatest, count = rows.agg(F.max(F.size("vector")), F.max(longest), F.count_if("anchor")).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    width = max(int(width), 1)
    bound = width * int(greatest or 0) ** 2
    shares = Fraction(low, 100), Fraction(high, 100)
    if bound * max(s.denominator + abs(s.numerator) for s in shares) >= MOST * 8:
        raise ValueError("scores of these vectors may not be exact; choose a smaller scale")
    moduli = primes(max(bound, 1))
    # Numbered in the order of ids, so that blocks are bounded whatever ids repeat.
    anchors = written(rows.where("anchor").select("vec_id", "label", "vector"), "anchors").withColumn("row", F.monotonically_increasing_id())
    anchors = written(number_rows(anchors, ["vec_id", "row"], "nth").drop("row"), "anchors")
    rows = rows.select("vec_id", "label", "vector")
    results = []
    for first in range(1, count + 1, block):
        part = anchors.where(F.col("nth").between(first, first + block - 1)).orderBy("nth").toArrow()
        names, labels = part.column("vec_id").to_pylist(), part.column("label").to_numpy()
        components = matrix(part.column("vector"), width, scale)
        message = {"residues": [residues(components, p) for p in moduli], "label": labels}
        shared = spark.sparkContext.broadcast(message)
        near = _ranked(rows.mapInArrow(_positives(shared, width, scale, moduli, positives), FOUND), positives + 1).drop("rank").collect()
        shared.destroy()
        own = (components * components).sum(axis=1)
        kept: list[list[tuple]] = [[] for _ in names]
        for row in sorted(near, key=lambda r: (r["slot"], -r["score"], r["vec_id"] is None, r["vec_id"] or 0)):
            kept[row["slot"]].append((row["score"], row["vec_id"]))
        # The anchor itself stands among them where its score with itself puts it.
        for k, mine in enumerate(kept):
            if (int(own[k]), names[k]) in mine:
                mine.remove((int(own[k]), names[k]))
            del mine[positives:]
        message |= {"low": np.ones((len(names), positives), np.int64), "high": np.zeros((len(names), positives), np.int64)}
        slots = []
        for k, mine in enumerate(kept):
            for n, (score, name) in enumerate(mine):
                message["low"][k, n] = -(-score * shares[0].numerator // shares[0].denominator)
                message["high"][k, n] = score * shares[1].numerator // shares[1].denominator
                slots.append((k * positives + n, names[k], name, score))
        shared = spark.sparkContext.broadcast(message)
        found = _ranked(rows.mapInArrow(_negatives(shared, width, scale, moduli, negatives), FOUND), negatives)
        # One row for each anchor of the block and its positives.
        sides = spark.createDataFrame(slots, "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        results.append(written(found.join(F.broadcast(sides), "slot").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives"))
        shared.destroy()
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out
