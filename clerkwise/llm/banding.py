"""Documents at a small edit distance, by banding of sampled fingerprint bits and verification.

Each of 24 bands is a sample of 40 of the 512 bits of a fingerprint, drawn for itself, so bands may share bits. Two
fingerprints that agree in all bits of a band meet in an index entry (band, value of its bits). Of pairs that differ in 23 bits 98
per cent meet in some band, of those that differ in 16 or less all but one in 1700; two unrelated texts meet by
chance in less than one case of 10^9, so what is compared grows with the texts, not with their pairs. Pairs that meet are verified on the full
fingerprints. Equal fingerprints are one member of the index, however many documents have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.blocks import apart, block_pairs, by_group, groups, pairs_apart
from clerkwise.llm.components import components
from clerkwise.llm.edit_embedding import PLACES, fingerprint_documents
from clerkwise.llm.frames import written

BITS = 4 * PLACES
BANDS = 24
WIDTH = 40           # bits of a band
DISTANCE = 23        # bits in which linked fingerprints may differ
BLOCK = 8192   # members of an index entry beyond which it is compared in blocks

_random = np.random.default_rng(404)
SAMPLED = [np.sort(_random.choice(BITS, WIDTH, replace=False)) for _ in range(BANDS)]


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def band_keys(prints: np.ndarray) -> np.ndarray:
    """Index entries of each fingerprint (rows of 64 bytes): the band above, the values of its bits below."""
    bits = np.unpackbits(prints, axis=1)
    out = np.empty((len(prints), BANDS), dtype=np.int64)
    for band, sampled in enumerate(SAMPLED):
        out[:, band] = bits[:, sampled].astype(np.int64) @ (np.int64(1) << np.arange(len(sampled), dtype=np.int64)) | (np.int64(band) << WIDTH)
    return out


def band_entries(prints: DataFrame) -> DataFrame:
    """(key, node) for all bands of all fingerprints (node, print)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a in range(0, part.num_rows, 4000):
                some = part.slice(a, 4000)
                nodes = np.repeat(some.column("node").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(_bytes(some.column("print"))).reshape(-1)), pa.array(nodes)], ["key", "node"])

    return prints.select("node", "print").mapInArrow(run, "key bigint, node bigint")


def _verified(dealt: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b, distance) of pairs of a group within the distance. A pair that other links of the group connect already is
    not named again, so a group of n members has at most n - 1 links however many of its pairs are near."""
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, words = table.column("node").to_numpy(), _bytes(table.column("print")).view(np.uint64)
        # Members that are connected have one label within their group; labels are joined as links are found.
        _, label = np.unique(table.column("root").to_numpy(), return_inverse=True)
        _, label = np.unique(groups(table) * (len(node) + 1) + label, return_inverse=True)
        above = np.arange(len(node))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        found: list[tuple[int, int, int]] = []
        for i, j in pairs_apart(table, label):
            far = np.bitwise_count(words[i] ^ words[j]).sum(axis=1)
            near = np.flatnonzero((far <= DISTANCE) & (label[i] != label[j]))
            for x, y, d in zip(i[near].tolist(), j[near].tolist(), far[near].tolist(), strict=True):
                p, q = top(label[x]), top(label[y])
                if p != q:
                    above[max(p, q)] = min(p, q)
                    found.append((max(node[x], node[y]), min(node[x], node[y]), d))
            if len(near):
                while (above != above[above]).any():
                    above[:] = above[above]
                label[:] = above[label]
        columns = np.array(found, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(columns[:, k].copy()) for k in range(3)], ["a", "b", "distance"])

    return by_group(dealt, prints, work, "a bigint, b bigint, distance bigint")


def fingerprint_links(prints: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, distance) between distinct fingerprints (node, print) that differ in at most ``DISTANCE`` bits, and the
    membership (node, root) of all linked ones.

    Every link is verified, and two fingerprints have one root exactly if a chain of pairs that are within the distance and
    share a band connects them; the links named are enough of those pairs to connect each root's fingerprints.
    """
    entries = band_entries(prints)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(entries.join(shared, "key").withColumn("root", F.col("node")), "members")
    # Of an entry with many members blocks drawn by chance, of at most half the size on average, are compared first.
    count = F.ceil(2 * F.col("size") / block)
    drawn = F.when(F.col("size") > block, F.pmod(F.xxhash64("key", "node"), count)).otherwise(0).cast("bigint")
    few = members.select("key", "node", "root", drawn.alias("low"), drawn.alias("high"), drawn.alias("block"))
    links = written(_verified(few, prints), "links")
    joined = components(links)
    many = written(members.where(F.col("size") > block).drop("root", "size").join(joined, "node", "left")
                   .select("key", "node", F.coalesce("root", "node").alias("root")), "many")
    if not many.isEmpty():
        # Then all blocks with each other, less those that are connected throughout.
        dealt = block_pairs(apart(many).select("key", "node", "root"), block)
        links = written(links.unionAll(_verified(dealt, prints)), "links")
        joined = components(links)
    return links.distinct(), joined


def fingerprint_groups(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``fingerprint_documents`` and ``representative``: the fingerprint that names the group of each.

    Documents whose fingerprints differ in at most ``DISTANCE`` of 512 bits, wherever they stand in the order
    of ids, have the same representative if their fingerprints share a band (98 per cent at the full distance, nearly all below); so have those that a
    chain of such documents connects. Nulls, ties, repeated rows and other columns as in ``fingerprint_documents``.
    """
    described = written(fingerprint_documents(documents).withColumn("node", F.xxhash64("fingerprint")), "fingerprints")
    prints = written(described.groupBy("node").agg(F.first(F.unhex("fingerprint")).alias("print")), "prints")
    _, joined = fingerprint_links(prints, block)
    names = prints.select(F.col("node").alias("root"), F.lower(F.hex("print")).alias("representative"))
    # One row per linked fingerprint, so that of many copies is split by the skew join.
    groups = joined.join(names, "root").select("node", "representative")
    return described.join(groups, "node", "left").withColumn("representative", F.coalesce("representative", "fingerprint")).drop("node")
