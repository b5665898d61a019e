"""Index entries of any size, compared in groups of bounded size.

An entry is compared member by member. One with many members is cut into blocks ordered by
component, and every two blocks (and every block with itself) are a group of their own, so no
task holds more than two blocks. Two blocks of one and the same component are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import written
from clerkwise.session import number_rows

GROUP = ["key", "low", "high"]
PORTION = 1 << 14   # pairs handed out at once


def apart(members: DataFrame) -> DataFrame:
    """The rows (key, node, root) of entries whose members are not all connected yet, with the entry's hub and size."""
    entries = (members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("hub_root"),
                                          F.max("root").alias("last_root"), F.min(F.struct("root", "node")).alias("hub"))
               .where("hub_root <> last_root").select("key", "size", "hub_root", F.col("hub.node").alias("hub")))
    return members.join(entries, "key")


def whole(members: DataFrame) -> DataFrame:
    """Entries as groups of one block each: the columns low, high and block are added."""
    zero = F.lit(0).cast("bigint")
    return members.select("key", "node", "root", zero.alias("low"), zero.alias("high"), zero.alias("block"))


def block_pairs(members: DataFrame, most: int) -> DataFrame:
    """Entries (key, node, root) cut into blocks of at most ``most`` members, dealt to the pairs of blocks to be compared.

    A row for each member and group: key, node, root, low and high (the blocks compared) and
    block (the member's own).
    """
    numbered = number_rows(members.select("key", "root", "node"), ["root", "node"], "nth", ["key"])
    placed = written(numbered.select("key", "node", "root", F.floor((F.col("nth") - 1) / most).cast("bigint").alias("block")), "blocks")
    spans = placed.groupBy("key", "block").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    low = spans.select("key", F.col("block").alias("low"), F.col("first").alias("one"))
    high = spans.select("key", F.col("block").alias("high"), F.col("last").alias("other"))
    # Blocks are ordered by root: if the first root of the lower equals the last of the higher, all between are of it.
    pairs = low.join(high, "key").where("low <= high and one <> other").select(*GROUP)
    to = pairs.select(*GROUP, F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return placed.join(to, ["key", "block"]).select("key", "node", "root", "low", "high", "block")


def by_group(dealt: DataFrame, payload: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over whole groups at a time, sorted by group and block; ``payload`` (node and others) is added to the rows."""
    rows = dealt.join(payload, "node")
    rows = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for part in batches:
            if not part.num_rows:
                continue
            columns = [part.column(c).to_numpy(zero_copy_only=False) for c in GROUP]
            last = [int(c[-1]) for c in columns]
            cut = int(np.flatnonzero(np.all([c == x for c, x in zip(columns, last, strict=True)], axis=0))[0])
            if cut:
                yield from work(pa.Table.from_batches([*held, part.slice(0, cut)]))
                held = []
            elif held and group != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(part.slice(cut))
            group = last
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def groups(table: pa.Table) -> np.ndarray:
    """The number of each row's group; the rows are sorted by group."""
    fresh = np.zeros(table.num_rows, dtype=bool)
    for c in GROUP:
        values = table.column(c).to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return np.cumsum(fresh)


def pairs_apart(table: pa.Table, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and j of all rows of one group that have different roots and, if two blocks meet, are of different blocks; in
    bounded portions. ``root`` may change on the way: what has become equal is passed over."""
    low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
    group = groups(table)
    alone = low == high
    at, step = np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        two = at[(root[at] != root[at + step]) & (alone[at] | (block[at] != block[at + step]))]
        for a in range(0, len(two), PORTION):
            some = two[a:a + PORTION]
            yield some, some + step
        step += 1
