"""Sliding-window admission over an event table.

An event is admitted when fewer than ``limit`` admitted events of its key lie in
the trailing window (an event exactly one window old still counts). Refused
events use up nothing, so a decision depends on the decisions before it.

A key's history is cut where that dependence ends. Time is divided into blocks; a block rests if no
event of the window before it has ``limit`` events in its own trailing window: all of those are
admitted whatever came earlier, so the state at the block's start is known. A
resting block starts a segment, and the others go on with the segment before them. Segments of one block are
decided at once, each as one sorted stream that holds one window of admitted times.

Of a longer segment, as of a key that never rests, all blocks are decided at once too. A block starts from a guess: what a walk over the block
before it, begun with nothing admitted, leaves in the last window. That guess is checked against what the block before really leaves; blocks that
started wrongly are decided again from there, a fixed number of rounds. Decisions soon forget where they began, so few blocks
are left after that; their segments are decided as one stream each. The number of passes is fixed, and the result does not depend on the guesses.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clerkwise.session import checkpointed

BLOCK_WINDOWS = 4
ROUNDS = 3


def admit_sliding(events: DataFrame, key: str, ts: str, event_id: str, limit: int,
                  window_seconds: int, block_windows: int = BLOCK_WINDOWS, rounds: int = ROUNDS) -> DataFrame:
    """Decision per event: event_id, allowed, remaining and reset_seconds.

    Events of a key are taken in (ts, event_id) order; a null key is a key like
    any other. The three columns are read a few times; write ``events`` first if they are dear to make.
    ``rounds`` bounds how often blocks that started from a wrong guess are decided again before their segment is
    decided as one stream.
    """
    if limit <= 0:
        return events.select(event_id, F.lit(True).alias("allowed"), F.lit(0).alias("remaining"),
                             F.lit(window_seconds).alias("reset_seconds"))
    if block_windows < 2:
        raise ValueError("a block spans two windows at least")
    window = window_seconds * 1_000_000
    width = window * block_windows
    times = events.select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"), F.col(event_id).cast("long").alias("id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts")
    ).withColumn("block", F.floor(F.col("ts") / F.lit(width)).cast("long"))
    # What the next block has to know: the window before it, and the window before that to judge it.
    late = times.filter(F.pmod("ts", F.lit(width)) >= width - 2 * window).withColumn("block", F.col("block") + 1)
    last_window = F.col("ts") >= F.col("block") * F.lit(width) - window
    earlier = F.lag("ts", limit).over(W.partitionBy("key", "block").orderBy("ts", "id"))
    busy = (late.withColumn("earlier", earlier).filter(last_window & (F.col("earlier") >= F.col("ts") - window))
            .select("key", "block", F.lit(True).alias("busy")).distinct())
    blocks = times.select("key", "block").distinct().join(busy, ["key", "block"], "left")
    rests = F.col("busy").isNull()
    placed = blocks.select("key", "block", rests.alias("rests"), F.sum(rests.cast("int")).over(W.partitionBy("key").orderBy("block")).alias("segment"))
    # One row for each block of each key.
    segments = checkpointed(placed.withColumn("blocks", F.count(F.lit(1)).over(W.partitionBy("key", "segment"))))
    # Known to be admitted: the window before a segment.
    sure = late.filter(last_window).join(segments.filter("rests"), ["key", "block"])
    own = times.join(segments, ["key", "block"])
    one = F.col("blocks") == 1
    decided = _stream(own.filter(one), sure.filter(one), limit, window)
    if not segments.filter("blocks > 1").isEmpty():
        many = F.col("blocks") > 1
        decided = decided.unionByName(_in_blocks(times, segments, own.filter(many), sure.filter(many), limit, window, width, rounds))
    return decided.select(
        F.col("id").alias(event_id), "allowed", "remaining",
        F.when(F.col("allowed"), F.lit(window_seconds))
        .otherwise(F.greatest(F.lit(1), F.floor(F.col("reset_us") / 1_000_000).cast("int"))).alias("reset_seconds"))


def _stream(own: DataFrame, sure: DataFrame, limit: int, window: int) -> DataFrame:
    """Whole segments, each as one sorted stream."""
    columns = ["key", "segment", "ts", "id"]
    rows = own.select(*columns, F.lit(False).alias("known")).unionByName(sure.select(*columns, F.lit(True).alias("known")))
    placed = rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "ts", "id")
    return placed.mapInArrow(_decide(limit, window), "id long, allowed boolean, remaining int, reset_us long")


SURE, GUESS, OWN = range(3)
_WALKED = """key string, segment long, block long, id long, allowed boolean, remaining int, reset_us long,
             entry array<long>, exit array<long>"""


def _in_blocks(times: DataFrame, segments: DataFrame, own: DataFrame, sure: DataFrame, limit: int, window: int, width: int, rounds: int) -> DataFrame:
    """Decisions of the segments of several blocks, all blocks at once."""
    place, columns = ["key", "segment", "block"], ["key", "segment", "block", "ts", "id"]

    def walked(rows: DataFrame) -> DataFrame:
        sorted_ = rows.repartition(*place).sortWithinPartitions(*place, "ts", "id")
        return checkpointed(sorted_.mapInArrow(_walk_blocks(limit, window, width), _WALKED))

    rows = own.select(*columns, F.lit(OWN).alias("kind"))
    later = segments.filter("blocks > 1 and not rests").select("key", "block", "segment")
    guesses = times.withColumn("block", F.col("block") + 1).join(later, ["key", "block"]).select(*columns, F.lit(GUESS).alias("kind"))
    layer = walked(rows.unionByName(guesses).unionByName(sure.select(*columns, F.lit(SURE).alias("kind"))))
    layers = [layer]
    ends = layer.filter("id is null").select(*place, "entry", "exit", F.lit(0).alias("layer"))
    order = W.partitionBy("key", "segment").orderBy("block")

    def wrong(ends: DataFrame) -> DataFrame:
        """Blocks that did not start with what the block before leaves, and what that is."""
        before = ends.withColumn("left", F.lag("exit").over(order))
        return checkpointed(before.filter("left is not null and left <> entry").select(*place, "left"))

    redo = wrong(ends)
    for number in range(1, rounds + 1):
        if redo.isEmpty():
            break
        again = rows.join(redo.select(*place), place).unionByName(
            redo.select(*place, F.explode("left").alias("ts"), F.lit(None).cast("long").alias("id"), F.lit(SURE).alias("kind")))
        layer = walked(again.select(*columns, "kind"))
        layers.append(layer)
        fresh = layer.filter("id is null").select(*place, "entry", "exit", F.lit(number).alias("layer"))
        ends = checkpointed(ends.join(fresh.select(*place), place, "left_anti").unionByName(fresh))
        redo = wrong(ends)
    lost = redo.select("key", "segment").distinct()
    decided = None
    for number, layer in enumerate(layers):
        mine = layer.filter("id is not null").join(ends.filter(F.col("layer") == number).select(*place), place, "left_semi")
        mine = mine.join(lost, ["key", "segment"], "left_anti").select("id", "allowed", "remaining", "reset_us")
        decided = mine if decided is None else decided.unionByName(mine)
    if not redo.isEmpty():
        decided = decided.unionByName(_stream(*[df.join(lost, ["key", "segment"], "left_semi") for df in (own, sure)], limit, window))
    return decided


def _walk_blocks(limit: int, window: int, width: int):
    """Decisions of the own rows of each block, and a row without an id for what it started with and what it leaves."""
    names = ["key", "segment", "block", "id", "allowed", "remaining", "reset_us", "entry", "exit"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def made(place, ids, allowed, remaining, reset, entry=None, left=None) -> pa.RecordBatch:
        n = len(ids)
        columns = [[place[0]] * n, [place[1]] * n, [place[2]] * n, ids, allowed, remaining, reset, [entry] * n, [left] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def summary(place, entry, recent) -> pa.RecordBatch:
        left = [t for t in recent if t >= (place[2] + 1) * width - window]
        return made(place, [None], [None], [None], [None], entry or [], left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, recent, entry = None, deque(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("key").dictionary_encode()
            keys = codes.dictionary.to_pylist()
            code = codes.indices.to_numpy(zero_copy_only=False)
            segment, block, ts, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "block", "ts", "kind"))
            ids = batch.column("id")
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(segment) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ts)], strict=True):
                now = (keys[code[a]], int(segment[a]), int(block[a]))
                if now != place:
                    if place is not None:
                        yield summary(place, entry, recent)
                    place, recent, entry = now, deque(), None
                # Rows before the block come first, then its own.
                own = a + int(np.searchsorted(kind[a:b] == OWN, True))
                for x, y in ((a, own), (own, b)):
                    if x == y:
                        continue
                    if x == own and entry is None:
                        entry = [t for t in recent if t >= place[2] * width - window]
                    allowed, remaining = np.ones(y - x, dtype=bool), np.zeros(y - x, dtype=np.int32)
                    reset = np.full(y - x, window, dtype=np.int64)
                    recent = _walk(ts[x:y], kind[x:y] == SURE, recent, limit, window, allowed, remaining, reset)
                    if x == own:
                        yield made(place, ids.slice(x, y - x).to_pylist(), allowed, remaining, reset)
        if place is not None:
            yield summary(place, entry, recent)

    return run


def _decide(limit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, recent = None, deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").dictionary_encode()
            names = keys.dictionary.to_pylist()
            code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            segment, ts, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "ts", "id"))
            known = batch.column("known").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(segment) != 0)) + 1
            allowed, remaining = np.ones(len(ts), dtype=bool), np.zeros(len(ts), dtype=np.int32)
            reset = np.full(len(ts), window, dtype=np.int64)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ts)], strict=True):
                now = (names[code[a]] if code[a] >= 0 else None, segment[a])
                if now != place:
                    place, recent = now, deque()
                recent = _walk(ts[a:b], known[a:b], recent, limit, window, allowed[a:b], remaining[a:b], reset[a:b])
            keep = ~known
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep]), pa.array(allowed[keep]), pa.array(remaining[keep]), pa.array(reset[keep])],
                ["id", "allowed", "remaining", "reset_us"])

    return run


def _walk(ts, known, recent: deque, limit: int, window: int, allowed, remaining, reset) -> deque:
    """Decide sorted times of one segment in place; returns the admitted times still in the window."""
    before = np.fromiter(recent, dtype=np.int64, count=len(recent))
    every = np.concatenate([before, ts])
    inside = np.arange(len(every)) - np.searchsorted(every, every - window, "left")
    inside = inside[len(before):]
    if (inside < limit).all():
        # Nobody is refused: the admitted events are all events.
        remaining[:] = limit - 1 - inside
        left = every[np.searchsorted(every, ts[-1] - window, "left"):]
        return deque(left.tolist())
    for i, (t, sure) in enumerate(zip(ts.tolist(), known.tolist(), strict=True)):
        while recent and recent[0] < t - window:
            recent.popleft()
        if sure or len(recent) < limit:
            recent.append(t)
            remaining[i] = max(limit - len(recent), 0)
        else:
            allowed[i] = False
            reset[i] = window - (t - recent[0])
    return recent
