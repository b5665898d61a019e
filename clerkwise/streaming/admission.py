"""Sliding-window admission of a stream, one small state per key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# Events per output frame.
CHUNK = 100_000

OUTPUT = "`key` string, id long, ts timestamp, allowed boolean, remaining int"


class AdmissionProcessor(StatefulProcessor):
    """Keeps the admitted times of one window, at most ``limit`` of them, until a key has been silent for ``expire_seconds``."""

    def __init__(self, limit: int, window_seconds: int, expire_seconds: int | None = None):
        self.limit = limit
        self.window = window_seconds * 1_000_000
        self.expire = None if expire_seconds is None else expire_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState(
            "recent", StructType([StructField("times", ArrayType(LongType())), StructField("last", LongType())]), self.expire)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, last = (deque(self.recent.get()[0]), self.recent.get()[1]) if self.recent.exists() else (deque(), None)
        # Two numbers an event are held for the sort, not the rows.
        parts = [(f["us"].to_numpy(), f["id"].to_numpy()) for f in rows]
        us, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((ids, us))
        for a in range(0, len(order), CHUNK):
            some = order[a:a + CHUNK]
            allowed, remaining = [], []
            for t in us[some].tolist():
                # A late event is judged at the time its key has reached.
                last = t if last is None else max(t, last)
                while times and times[0] < last - self.window:
                    times.popleft()
                allowed.append(len(times) < self.limit)
                if allowed[-1]:
                    times.append(last)
                remaining.append(self.limit - len(times) if allowed[-1] else 0)
            yield pd.DataFrame({"key": key[0], "id": ids[some], "ts": pd.to_datetime(us[some], unit="us", utc=True), "allowed": allowed,
                                "remaining": remaining}).astype({"remaining": "int32"})
        self.recent.update((list(times), last))

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_seconds: int,
                 expire_seconds: int | None = None) -> DataFrame:
    """Admission of a stream, events of a key in time order within a micro-batch.

    ``expire_seconds`` drops the state of a key that has been silent for so long by the clock of the run, so that keys at rest cost
    nothing. Such a stream looks after its state by the clock, so a drained run (``availableNow``) of it does not end; run it with a
    processing-time trigger, or once. Decisions stay the same as long as it is not less than the window plus the longest time an event is under way. Without it the state
    of every key ever seen is kept.

    Late events, older than one already decided for their key, are judged at that one's time: the
    clock of a key never goes back. The state holds ``limit`` times at most for each key. A task holds
    two numbers per event of one key and micro-batch, so give the source a
    rate limit (``maxBytesPerTrigger``, ``maxFilesPerTrigger``).

    Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("id"),
                         F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(
        AdmissionProcessor(limit, window_seconds, expire_seconds), OUTPUT, "Append", "None" if expire_seconds is None else "ProcessingTime")
