"""Removal of every byte that lies in a 200-byte string found elsewhere, by sorting sampled suffixes.

The steps are those of a distributed difference-cover suffix sort, cut off at the length that
matters. (1) A sample of the positions is named by the bytes that follow. The sample is content
defined: of each 200-byte string the position with the least 50-byte hash is in it, so equal strings
always meet in a sampled position at the same distance, which is what a difference
cover is for. (2) Names that occur once are done; for the others the names are made longer, by
recursion: the strings around a sampled position are taken in blocks of 32, then 8, then 1
neighbouring starts. A block's core is what all its strings share, its full name is all they
cover. Only blocks of equal core can hold equal strings, and equal full names settle a block whole.
(3) What remains is merged level by level until (4) single strings of equal core are compared.

Copies of a name are counted before any shuffle and only distinct contents go down a level,
so a passage that is everywhere costs a few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import about, map_texts, written
from clerkwise.llm.text_arrays import (
    BYTE_CODES,
    Powers,
    covered,
    mix,
    range_hashes,
    slices,
    text_bytes,
    window_hashes,
    window_min,
)

LENGTH = 200
SEED = 50
LEVELS = (32, 8, 1)

RUNS = "array<struct<least: bigint, start: int, n: int, back: int>>"


def describe(documents: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, sha, n_bytes and runs of every row.

    A run is ``n`` successive starts of strings whose least hash is at the same position,
    ``back`` bytes behind the first start.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    keep = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not keep:
            keep.append(Powers())
        data, offsets = text_bytes(part.column("text"))
        grams = window_hashes(BYTE_CODES[data], seed, keep[0])
        columns, count = ([], [], [], []), [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            more = 0
            if b - a >= length:
                own = grams[a:b - seed + 1]
                at = window_min(own, length - seed + 1)
                first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                more = len(first)
                for column, values in zip(columns, (own[at[first]].view(np.int64), first, np.diff(np.append(first, len(at))), at[first] - first), strict=True):
                    column.append(values)
            count.append(count[-1] + more)
        flat = [np.concatenate([*c, np.zeros(0, np.int64)]) for c in columns]
        runs = pa.StructArray.from_arrays([pa.array(flat[0]), *[pa.array(c.astype(np.int32)) for c in flat[1:]]], ["least", "start", "n", "back"])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sha"), pa.array(np.diff(offsets)),
                                           pa.ListArray.from_arrays(pa.array(count, pa.int32()), runs)], ["doc_id", "sha", "n_bytes", "runs"])

    return map_texts(rows, run, f"doc_id {kind}, sha string, n_bytes bigint, runs {RUNS}")


def _texts(documents: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (node and others) with the text of the node; each text comes once."""
    wanted = asked.join(classes.select("node", "doc_id", "sha"), "node")
    wanted = written(wanted, "asked")
    some = about(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), wanted.select("doc_id"))
    once = some.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"))
    return once.join(wanted.drop("doc_id"), "sha")


def _blocks(texts: DataFrame, length: int, size: int) -> DataFrame:
    """Named blocks of at most ``size`` neighbouring starts; ``texts`` has node, text and ranges (start, n, back, weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            lists = part.column("ranges")
            many = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            start, n, back, weight = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            row = np.repeat(np.arange(part.num_rows), many)
            # Blocks are cut at multiples of ``size`` of the distance to the sampled position.
            high, low = back // size, (back - n + 1) // size
            times = high - low + 1
            source = np.repeat(np.arange(len(start)), times)
            step = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
            block = high[source] - step
            sample = start[source] + back[source]
            first = np.maximum(start[source], sample - block * size - (size - 1))
            last = np.minimum(start[source] + n[source] - 1, sample - block * size)
            base = offsets[row[source]]
            order = np.lexsort((first, row[source]))
            source, block, sample, first, last, base = (x[order] for x in (source, block, sample, first, last, base))
            core_from = sample - block * size
            core = range_hashes(data, base + core_from, base + core_from - (size - 1) + length, powers)
            full = range_hashes(data, base + first, base + last + length, powers)
            core = mix(core + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            full = mix(full + (sample - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), part.column("node").take(pa.array(row[source])),
                 pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                 pa.array((sample - first).astype(np.int32)), pa.array(weight[source].astype(np.int32))],
                ["core", "full", "node", "start", "n", "back", "weight"])

    return texts.select("node", "text", "ranges").mapInArrow(
        run, "core bigint, full bigint, node bigint, start int, n int, back int, weight int")


def repeated_starts(documents: DataFrame, described: DataFrame, classes: DataFrame, length: int, levels: tuple[int, ...]) -> DataFrame:
    """(node, start, n): all starts, in runs of ``n``, of strings that also start elsewhere, in texts that occur once."""
    runs = classes.select("node", "weight", F.explode("runs").alias("r")).select("node", "weight", "r.*")
    shared = (runs.groupBy("least").agg(F.count(F.lit(1)).alias("times"), F.min("weight").alias("least_weight"))
              .where("times > 1 and least_weight = 1").select("least"))
    ranges = runs.join(shared, "least").select("node", "start", "n", "back", "weight")
    found = None
    for size in levels:
        asked = ranges.groupBy("node").agg(F.collect_list(F.struct("start", "n", "back", "weight")).alias("ranges"))
        blocks = written(_blocks(_texts(documents, classes, asked), length, size), "blocks")
        contents = (blocks.groupBy("core", "full").agg(F.sum("weight").alias("weight"), F.min(F.struct("node", "start", "n", "back")).alias("one")))
        contents = written(contents, "contents")
        same = blocks.where("weight = 1").join(contents.where("weight > 1").select("core", "full"), ["core", "full"]).select("node", "start", "n")
        same = written(same, "repeated")
        found = same if found is None else found.unionAll(same)
        # One row for each distinct content of a core that has several, if any of them is still open.
        open_ = (contents.groupBy("core").agg(F.count(F.lit(1)).alias("contents"), F.min("weight").alias("least"))
                 .where("contents > 1 and least = 1").select("core"))
        ranges = contents.join(open_, "core").select("one.node", "one.start", "one.n", "one.back", F.least("weight", F.lit(2)).alias("weight"))
    return found


def drop_repeated_bytes(documents: DataFrame, length: int = LENGTH, seed: int = SEED, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``documents`` (doc_id, text).

    Removed is each byte covered by a string of ``length`` bytes that also starts at another
    place of any text, the same one included; ``n_spans`` counts the maximal removed runs. Strings
    are judged on the input. Null texts are empty; null, repeated and shared ids make no
    difference, each row is a text of its own; other columns are ignored; an empty table gives no rows.
    """
    if not 0 < seed < length or levels[-1] != 1 or max(levels) > length:
        raise ValueError("seed must be shorter than length, and the last level 1")
    described = written(describe(documents, length, seed), "described")
    # Equal texts are one class; a text that occurs twice and is long enough is removed whole.
    classes = (described.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight"), F.first("runs").alias("runs"))
               .withColumn("node", F.xxhash64("sha")))
    classes = written(classes, "classes")
    starts = repeated_starts(documents, described, classes, length, levels)
    asked = starts.groupBy("node").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    texts = _texts(documents, classes, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            lists = part.column("starts")
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            start, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            out = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                mine = slice(edge[i], edge[i + 1])
                gone = covered(start[mine], n[mine] + length - 1, b - a)
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((int(gone.sum()), spans, hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest()))
            removed, spans, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("sha"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
                                             ["sha", "removed", "spans", "left"])

    cut = texts.select("sha", "text", "starts").mapInArrow(run, "sha string, removed bigint, spans bigint, left string")
    # One row for each text that changes: those that lose some bytes, and those that occur more than once.
    whole = classes.where("weight > 1").select("sha", F.lit(True).alias("whole"))
    out = described.drop("runs").join(whole, "sha", "left").join(cut, "sha", "left")
    all_ = F.col("whole").isNotNull() & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))
