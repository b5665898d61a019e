"""Near-duplicate documents by b-bit minwise signatures and a multi-index Hamming join.

A document is its set of five-word shingles. Equal sets form a class; each class has a signature
of 64 minimum hashes, 16 bits of each. Two signatures that differ in at most 31 places must,
by the pigeonhole principle, differ in at most one place of some of the 16 chunks of four; so
every chunk is entered in the index four times, each time without one of its places, and
every pair under the distance meets in some entry. Candidates are confirmed on the full sets.

Large groups are never paired off. In each entry the members first vote for one hub, then for
their nearest member of another component, a few rounds; votes are checked, and what is
linked counts as one. Only members that are still apart are then compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.blocks import apart, block_pairs, by_group, pairs_apart, whole
from clerkwise.llm.components import components
from clerkwise.llm.frames import key_map, map_texts, written
from clerkwise.llm.text_arrays import LOWER_CODES, SPACED, Powers, mix, span_hashes, text_bytes, word_spans

WORDS = 5
PLACES = 64
CHUNK = 4
ERRORS = 1
DISTANCE = PLACES // CHUNK * (ERRORS + 1) - 1
SIMILAR = 75  # per cent
# One bit of as many further minimum hashes judges candidates more sharply before they are confirmed. At the
# similarity asked for an eighth of the bits differs; 4.5 standard deviations more are allowed.
SKETCH = 2048
SKETCH_DISTANCE = int(SKETCH / 8 + 4.5 * (SKETCH * 7 / 64) ** 0.5)
PORTION = 512  # sets described at once
HOT = 16384   # members of an index entry beyond which it is compared in blocks of so many

_random = np.random.default_rng(606)
FACTORS = _random.integers(1, 1 << 31, PLACES + SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, PLACES + SKETCH, dtype=np.uint32)
SHINGLE = _random.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, powers: Powers, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    starts, ends, edge = word_spans(data, offsets, SPACED)
    hashes = span_hashes(data, starts, ends, powers, LOWER_CODES)
    grams = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        grams += hashes[k:k + len(grams)] * SHINGLE[k]
    grams = mix(grams)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            out.append(mix(np.sum(hashes[a:b] * SHINGLE[:b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set ``PLACES`` 16-bit places and then the sketch, 16 bits to a column; the sets are not empty."""
    out = np.empty((len(sets), PLACES + SKETCH // 16), dtype="<u2")
    for first in range(0, len(sets), PORTION):
        some = sets[first:first + PORTION]
        short = (np.concatenate(some) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(s) for s in some[:-1]])
        hashed = np.empty_like(short)
        bits = np.empty((len(some), SKETCH), dtype=bool)
        for k, (a, b) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
            np.multiply(short, a, out=hashed)
            hashed += b
            least = np.minimum.reduceat(hashed, at)
            if k < PLACES:
                out[first:first + len(some), k] = least & np.uint32(0xFFFF)
            else:
                bits[:, k - PLACES] = least >> np.uint32(12) & np.uint32(1)
        out[first:first + len(some), PLACES:] = np.packbits(bits, axis=1).view("<u2")
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Index entries of each signature: chunk and left-out place above, the other three places below."""
    wide = signature.astype(np.int64)
    out = []
    for first in range(0, PLACES, CHUNK):
        for left_out in range(CHUNK):
            a, b, c = (first + k for k in range(CHUNK) if k != left_out)
            out.append((np.int64(first + left_out) << 48) | (wide[:, a] << 32) | (wide[:, b] << 16) | wide[:, c])
    return np.stack(out, axis=1)


def describe(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, node (which set; null for an empty one) and signature of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    keep = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not keep:
            keep.append(Powers())
        sets = shingle_sets(part.column("text"), keep[0])
        full = [s for s in sets if len(s)]
        marks = iter(signatures(full).astype("<u2")) if full else iter(())
        nodes = [node_of(s) if len(s) else None for s in sets]
        signs = [next(marks).tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
             pa.array(signs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "node", "signature"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_texts(rows, run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, node bigint, signature binary")


def _signs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sketches of a signature column, whose values are all of one size; read where Arrow holds them."""
    width = PLACES + SKETCH // 16
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        first = int(np.frombuffer(chunk.buffers()[1], np.int32, 1, chunk.offset * 4)[0]) if len(chunk) else 0
        parts.append(np.frombuffer(chunk.buffers()[2], "<u2", len(chunk) * width, first) if len(chunk) else np.zeros(0, "<u2"))
    whole = (np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, "<u2")).reshape(-1, width)
    return whole[:, :PLACES], whole[:, PLACES:]


def _places(column: pa.Array) -> np.ndarray:
    return _signs(column)[0]


def index_entries(classes: DataFrame) -> DataFrame:
    """(key, node) for all index entries of all classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a in range(0, part.num_rows, 2000):
                some = part.slice(a, 2000)
                keys = index_keys(_places(some.column("signature")))
                nodes = np.repeat(some.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key bigint, node bigint")


def confirm(pairs: DataFrame, classes: DataFrame, documents: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets have the similarity.

    The sets are made anew from one document of each class that occurs in a pair.
    """
    nodes = pairs.select(F.col("a").alias("node")).distinct().unionAll(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    wanted = written(nodes.join(classes.select("node", "doc_id"), "node"), "wanted")
    keep = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not keep:
            keep.append(Powers())
        sets = shingle_sets(part.column("text"), keep[0])
        nodes = [node_of(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()),
                                           pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "node", "shingles"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    # Left out and described in one Python worker: two in a row would double what the workers of an executor hold.
    rows, pick, shared = key_map(documents.select("doc_id", "text"), wanted)
    sets = map_texts(rows, run, f"doc_id {kind}, node bigint, shingles array<bigint>", pick)
    # A class is represented by the document chosen for it; rows that repeat its id and text are alike.
    chosen = sets.join(wanted.select(F.col("node").alias("n"), F.col("doc_id").alias("d")),
                       (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    sets = written(chosen.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    shared.destroy()
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"),
                                                         F.size(F.array_intersect("x", "y")).cast("bigint").alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("a", "b")


def _votes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """For each node the hub of another component that it meets most often, if the signatures are near enough."""
    votes = members.where("root <> hub_root").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    signs = classes.select("node", "signature")
    pairs = (best.join(signs, "node").withColumnRenamed("signature", "x")
             .join(signs.select(F.col("node").alias("hub"), F.col("signature").alias("y")), "hub"))
    return pairs.mapInArrow(_near, "node bigint, hub bigint").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            far = (_places(part.column("x")) != _places(part.column("y"))).sum(axis=1)
            yield part.select(["node", "hub"]).filter(pa.array(far <= DISTANCE))


def _near_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places i and j of all members of one group that are in different components and near by signature and sketch,
    their distance, and which of the signature's places are equal; in bounded portions."""
    sign, sketch = _signs(table.column("signature"))
    for i, j in pairs_apart(table, table.column("root").to_numpy()):
        same = sign[i] == sign[j]
        far = PLACES - same.sum(axis=1)
        near = np.flatnonzero(far <= DISTANCE)
        near = near[np.bitwise_count(sketch[i[near]] ^ sketch[j[near]]).sum(axis=1) <= SKETCH_DISTANCE]
        if len(near):
            yield i[near], j[near], far[near], same[near]


def _nearest(members: DataFrame, classes: DataFrame) -> DataFrame:
    """For each node its nearest node (a, b) in another component, if that is near enough."""
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        best = np.full(len(node), PLACES + 1, dtype=np.int64)
        other = np.zeros(len(node), dtype=np.int64)
        for i, j, far, _ in _near_pairs(table):
            for x, y in ((i, j), (j, i)):
                nearer = far < best[x]
                best[x[nearer]], other[x[nearer]] = far[nearer], node[y[nearer]]
        found = best <= DISTANCE
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(other[found]), pa.array(best[found])], ["a", "b", "far"])

    found = by_group(whole(members), classes.select("node", "signature"), work, "a bigint, b bigint, far bigint")
    return found.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _compare(members: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """All pairs (a, b) of members of an entry (key, node, root, size) that are in different components and near by signature.

    Entries of more than ``hot`` members are compared block by block. A pair that meets in several
    entries is named in the first of them only.
    """
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, entry = table.column("node").to_numpy(), table.column("key").to_numpy() >> 48
        for i, j, _, same in _near_pairs(table):
            # An entry leaves one place of its chunk out; the two share it if the chunk's other places are equal.
            chunks = same.reshape(-1, PLACES // CHUNK, CHUNK)
            shared = (chunks.sum(axis=2, keepdims=True) - chunks >= CHUNK - 1).reshape(-1, PLACES)
            first = shared.argmax(axis=1) == entry[i]
            if first.any():
                x, y = node[i[first]], node[j[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    dealt = whole(members.where(F.col("size") <= hot)).unionByName(block_pairs(members.where(F.col("size") > hot), hot))
    return by_group(dealt, classes.select("node", "signature"), work, "a bigint, b bigint")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after ``links`` (a, b) between nodes: only the roots that a link connects are looked at again."""
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    between = links.join(of_a, "a").join(of_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return written(roots.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "roots")


def _connected(documents: DataFrame, rounds: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``describe`` of all rows, the classes (node, doc_id, signature), and (node, root) of all classes that share an index entry."""
    described = written(describe(documents), "described")
    classes = written(described.where("node is not null").groupBy("node")
                      .agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "classes")
    entries = index_entries(classes)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(entries.join(shared, "key"), "members")
    roots = written(members.select("node").distinct().withColumn("root", F.col("node")), "roots")
    if rounds < 1:
        raise ValueError("at least one round of votes")
    for turn in range(rounds + 1):
        rooted = written(apart(members.select("key", "node").join(roots, "node")), "apart")
        if turn == 0:
            pairs = _votes(rooted, classes)
        elif turn < rounds:
            pairs = _nearest(rooted.where(F.col("size") <= hot), classes)
        else:
            pairs = _compare(rooted, classes, hot).distinct()
        # What is linked already counts as one node in the rounds that follow.
        roots = _merged(roots, written(confirm(written(pairs, "pairs"), classes, documents), "confirmed"))
        members = rooted.select("key", "node")
    return described, classes, roots


def near_duplicates(documents: DataFrame, rounds: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and a hash of the text for every row of ``documents`` (doc_id, text).

    ``component_id`` is the least doc_id connected by links of similarity 0.75 or more; ``kept``
    marks that document. Null and empty texts have no shingles and stand alone. Rows with a
    null id are connected like others but are never the least; a component of such rows alone has
    a null component_id and is kept. Rows that share an id are judged one by one. Other columns
    are ignored; an empty table gives no rows.
    """
    described, classes, roots = _connected(documents, rounds, hot)
    least = roots.join(classes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    groups = roots.join(least, "root").select("node", "least")
    # One row per class, so the classes of many copies are split by the skew join.
    of_class = classes.select("node", "doc_id").join(groups, "node", "left").select("node", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"))
    out = described.join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
                      "text_hash")


def keep_one_of_each(documents: DataFrame, rounds: int = 3, hot: int = HOT) -> DataFrame:
    """The rows of ``documents``, all columns as they are, less all but one of each group of near duplicates.

    The row of the least doc_id stays, a null id only if the group has no other, and of the rows of that id the one of the least text
    hash; rows that repeat both id and text stay once. Null and empty texts, and others without a word, stand alone and stay (once, if
    id and text repeat). Columns of any other names pass through; an empty table gives no rows.
    """
    described, _, roots = _connected(documents, rounds, hot)
    alone = described.where("node is null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    # A row per class first, so that a class of many copies is one row in the join.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    firsts = described.where("node is not null").groupBy("node").agg(F.min(order).alias("first"))
    group = F.coalesce("root", "node")
    chosen = firsts.join(roots, "node", "left").groupBy(group.alias("group")).agg(F.min("first").alias("first"))
    kept = chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")).unionAll(alone).distinct()
    rows = documents.withColumn("__text_hash", F.xxhash64("text"))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    return stay.dropDuplicates(["doc_id", "__text_hash"]).select(*documents.columns)
