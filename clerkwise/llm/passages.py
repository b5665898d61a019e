"""Removal of passages of fifty words and more that an earlier document holds, over a de Bruijn graph.

Every run of 50 words is an edge between its first and its last 49 words. Only edges that can
repeat are ever made: equal runs have the same least 25-word hash inside, so runs whose least hash
occurs in one document only are left out before. An edge's home is its first place in document
order. Edges that lead on from each other without a branch, so that a place and its home both
move on by one word, are compacted to one path (start, length, home). Before words go, the words
of a path are compared with those at its home by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clerkwise.llm.frames import about, join_one, map_texts, written
from clerkwise.llm.text_arrays import SPACED, Powers, covered, slices, span_hashes, text_bytes, window_hashes, window_min, word_spans

EDGE = 50
SEED = 25

# The row whose text stands for a class of equal words: its id and a hash of its text tell it from all others.
NAME = ["doc_id", "text_hash"]
RUNS = "array<struct<least: bigint, place: int, edges: int>>"


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words of a text joined by one space."""
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def describe(documents: DataFrame, edge: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n_words, words_sha256 and the runs of edges that share a least hash, of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    keep = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not keep:
            keep.append(Powers())
        data, offsets = text_bytes(part.column("text"))
        starts, ends, rows = word_spans(data, offsets, SPACED)
        grams = window_hashes(span_hashes(data, starts, ends, keep[0]), seed, keep[0])
        sha, least, place, edges, count = [], [], [], [], [0]
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            sha.append(hashlib.sha256(_joined(data, starts[a:b], ends[a:b])).hexdigest())
            if b - a >= edge:
                own = grams[a:b - seed + 1]
                at = window_min(own, edge - seed + 1)
                first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                least.append(own[at[first]])
                place.append(first)
                edges.append(np.diff(np.append(first, len(at))))
            count.append(sum(map(len, place[-1:])) + count[-1] if b - a >= edge else count[-1])
        flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0)]).astype(kind) if kind != np.int64 else
                                            np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64))
        runs = pa.StructArray.from_arrays([flat(least, np.int64), flat(place, np.int32), flat(edges, np.int32)], ["least", "place", "edges"])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(rows)), pa.array(sha), pa.ListArray.from_arrays(pa.array(count, pa.int32()), runs)],
            [*NAME, "n_words", "words_sha256", "runs"])

    return map_texts(_named(documents), run, f"doc_id {kind}, text_hash bigint, n_words bigint, words_sha256 string, runs {RUNS}")


def _named(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _texts(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (NAME and others) with the texts; a row that repeats id and text comes once."""
    found = about(documents.select("doc_id", "text"), asked.select("doc_id"))
    return _named(found).join(asked, NAME).dropDuplicates(NAME)


def _edges(texts: DataFrame, edge: int) -> DataFrame:
    """(edge, doc_id, text_hash, place) of the wanted runs of each text; columns NAME, words_sha256, runs, text."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, rows = word_spans(data, offsets, SPACED)
            hashes = span_hashes(data, starts, ends, powers)
            out, place, owner = [], [], []
            wanted = part.column("runs").to_pylist()
            for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                flag = covered(np.array([r["place"] for r in wanted[i]]), np.array([r["edges"] for r in wanted[i]]), b - a - edge + 1)
                at = np.flatnonzero(flag)
                out.append(window_hashes(hashes[a:b], edge, powers)[at])
                place.append(at.astype(np.int32))
                owner.append(np.full(len(at), i))
            if out:
                owner = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out).view(np.int64)), part.column("doc_id").take(owner), part.column("text_hash").take(owner), pa.array(np.concatenate(place))],
                    ["edge", *NAME, "place"])

    return texts.mapInArrow(run, f"edge bigint, doc_id {kind}, text_hash bigint, place int")


def _digests(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (NAME, start, words) with the digest of the words there."""
    asked = written(spans.groupBy(*NAME).agg(F.collect_list(F.struct("start", "words")).alias("spans")), "spans")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, rows = word_spans(data, offsets, SPACED)
            ids, names, asked = (part.column(c).to_pylist() for c in (*NAME, "spans"))
            out = []
            for i, a in enumerate(rows[:-1].tolist()):
                for s in asked[i]:
                    x, y = a + s["start"], a + s["start"] + s["words"]
                    out.append((ids[i], names[i], s["start"], s["words"], hashlib.sha256(_joined(data, starts[x:y], ends[x:y])).digest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field("doc_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                                              pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], [*NAME, "start", "words", "digest"])

    return _texts(documents, asked).mapInArrow(run, f"doc_id {kind}, text_hash bigint, start int, words int, digest binary")


def repeated_paths(documents: DataFrame, classes: DataFrame, edge: int) -> DataFrame:
    """Compacted paths of edges whose home is in a document with a smaller id.

    ``classes`` has NAME and runs of each class. Columns NAME, start, words, home_id, home_hash, home_start, and the digest of the words at home.
    """
    # Runs whose least hash occurs in two documents; the shuffle sees one row per run, not per edge.
    runs = written(classes.select(*NAME, F.explode("runs").alias("r")).select(*NAME, "r.least", "r.place", "r.edges"), "runs")
    shared = (runs.groupBy("least").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("times"))
              .where("low < high").select("least", "times"))
    wanted = written(join_one(runs, shared, "least").groupBy(*NAME).agg(F.collect_list(F.struct("place", "edges")).alias("runs")), "wanted")
    edges = written(_edges(_texts(documents, wanted), edge), "edges")
    homes = (edges.groupBy("edge").agg(F.min(F.struct(*NAME, "place")).alias("home"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("times"))
             .where("home.doc_id < high").select("edge", F.col("home.doc_id").alias("home_id"), F.col("home.text_hash").alias("home_hash"),
                                                 F.col("home.place").alias("home_place"), "times"))
    places = join_one(edges, homes, "edge").where("home_id < doc_id").select(*NAME, "place", "home_id", "home_hash", "home_place")
    # Places of one text only, so a partition of this window is as long as a document.
    order = W.partitionBy(*NAME).orderBy("place")
    goes_on = ((F.lag("place").over(order) + 1 == F.col("place")) & (F.lag("home_id").over(order) == F.col("home_id"))
               & (F.lag("home_hash").over(order) == F.col("home_hash")) & (F.lag("home_place").over(order) + 1 == F.col("home_place")))
    path = places.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("new").over(order))
    paths = (path.groupBy(*NAME, "path").agg(F.min("place").alias("start"), (F.count(F.lit(1)) + (edge - 1)).cast("int").alias("words"),
                                             F.first("home_id").alias("home_id"), F.first("home_hash").alias("home_hash"), F.min("home_place").alias("home_start")).drop("path"))
    paths = written(paths, "paths")
    home = ["home_id", "home_hash", "home_start", "words"]
    asked = paths.select(*home).distinct().select(F.col("home_id").alias("doc_id"), F.col("home_hash").alias("text_hash"), F.col("home_start").alias("start"), "words")
    there = _digests(documents, asked).select(F.col("doc_id").alias("home_id"), F.col("text_hash").alias("home_hash"), F.col("start").alias("home_start"), "words", "digest")
    return paths.join(there, home)


def drop_repeated_passages(documents: DataFrame, edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``kept`` (the places of kept words, as spans) of every row.

    Words are runs of anything but ASCII white space. A word goes if it lies in a run of ``edge``
    words that also starts in a document with a smaller doc_id, judged on the input. Null and
    empty texts have no words. Rows with a null id are neither changed nor looked up. Every
    row is a document of its id, also where ids repeat: rows of one id take nothing from each other. Other columns are
    ignored; an empty table gives no rows. Texts of one id are told apart by a 64-bit hash.
    """
    if not 0 < seed <= edge:
        raise ValueError("seed must be between 1 and edge")
    described = written(describe(documents, edge, seed), "described")
    nothing = hashlib.sha256(b"").hexdigest()
    # Texts of the same words are one class, named by its row of the least id (and text hash); only that row has edges.
    texts = described.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= edge))
    classes = texts.groupBy("words_sha256").agg(F.min_by(F.struct(*NAME, "runs"), F.struct(*NAME)).alias("one")).select("words_sha256", "one.*")
    classes = written(classes, "classes")
    paths = repeated_paths(documents, classes.drop("words_sha256"), edge)
    asked = paths.groupBy(*NAME).agg(F.collect_list(F.struct("start", "words", "digest")).alias("paths"))
    found = _texts(documents, written(asked, "asked"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, rows = word_spans(data, offsets, SPACED)
            ids, names, asked = (part.column(c).to_pylist() for c in (*NAME, "paths"))
            out = []
            for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                same = [p for p in asked[i] if hashlib.sha256(_joined(data, starts[a + p["start"]:a + p["start"] + p["words"]],
                                                                      ends[a + p["start"]:a + p["start"] + p["words"]])).digest() == p["digest"]]
                gone = covered(np.array([p["start"] for p in same], dtype=np.int64), np.array([p["words"] for p in same], dtype=np.int64), b - a)
                left = np.flatnonzero(~gone) + a
                out.append((ids[i], names[i], int(gone.sum()), hashlib.sha256(_joined(data, starts[left], ends[left])).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field("doc_id").type), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], [*NAME, "removed", "left_sha256"])

    cut = found.mapInArrow(run, f"doc_id {kind}, text_hash bigint, removed bigint, left_sha256 string")
    # One row a class: what is left of the words where they stand first. Rows of the same words and a greater id lose them all.
    of_class = (classes.select(*NAME, "words_sha256").join(cut, NAME, "left")
                .select("words_sha256", F.col("doc_id").alias("first_id"), "removed", "left_sha256"))
    out = described.drop("runs", "text_hash").join(of_class, "words_sha256", "left")
    copy, first = (F.coalesce(c, F.lit(False)) for c in (F.col("doc_id") > F.col("first_id"), F.col("doc_id") == F.col("first_id")))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(first, F.coalesce("removed", F.lit(0))).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(nothing)).when(first, F.coalesce("left_sha256", "words_sha256")).otherwise(F.col("words_sha256")).alias("kept_sha256"))
