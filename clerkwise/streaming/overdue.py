"""The overdue scan as a stream: a timer for each document in place of scheduled runs over all."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clerkwise.functions.predicates import DONE
from clerkwise.functions.text import strip
from clerkwise.operators.sla import ESCALATION_DAYS, LOOKBACK_MINUTES

DAY_MS = 86_400_000
STATE = "workspace_id string, filename string, assigned_to string, due long, next long, seen long"
# The documents of a bucket, pickled: the key of each with its row of STATE. ``timer`` is the least of their next times.
BUCKET_STATE = "timer long, documents binary"
BUCKETS = 8192
# Notices of one document in a row: ``n`` of them from ``at`` on.
RUN = "document_id string, workspace_id string, filename string, assigned_to string, due long, at long, n long"
RUN_COLUMNS = [part.split()[0] for part in RUN.split(", ")]
MISSING = -2**63  # a time that is not known


def _latest(row: Row | dict) -> tuple:
    """The order of the changes of a document; what is missing comes last."""
    seen, due, name = row["seen"], row["due"], row["filename"]
    return seen is None, seen or 0, due is None, due or 0, name is None, name or ""


class OverdueProcessor(StatefulProcessor):
    """Keeps what a notice needs of each open document with a due date, and the time of its next notice.

    A document is read and written once a batch, and the one timer that it has is known by the time in its state. Its notices leave as
    runs, which ``notices`` spells out.
    """

    def __init__(self, fallback_user: str, after_days: int, every_ms: int, days: int | None):
        self.fallback, self.after, self.every, self.days = fallback_user, after_days, every_ms, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[tuple]:
        last = max(rows, key=_latest)
        held = self.document.get()
        if held is not None and None not in (held[5], last["seen"]) and held[5] > last["seen"]:
            return
        if held is not None:
            self.handle.deleteTimer(held[4])
        if last["due"] is None or not last["open"]:
            if held is not None:
                self.document.clear()
            return
        due = last["due"]
        # No second notice within the look-back of the last one, whatever has changed meanwhile.
        soonest = held[4] if held is not None and held[4] > held[3] else due
        text = (last["workspace_id"], last["filename"], last["assigned_to"])
        yield from self._advance(key[0], (*text, due, max(due, soonest), last["seen"]), timerValues.getCurrentWatermarkInMs(), held is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[tuple]:
        held = self.document.get()
        if held is not None:
            yield from self._advance(key[0], held, timerValues.getCurrentWatermarkInMs(), True)

    def _advance(self, name: str, document: tuple, now: int, held: bool) -> Iterator[tuple]:
        """All notices before ``now``, and a timer for the next one."""
        workspace, filename, user, due, at, seen = document
        end = now if self.days is None else min(now, due + self.days * DAY_MS)
        if at < end:
            n = -((at - end) // self.every)
            yield name, workspace, filename, user, due, at, n
            at += n * self.every
            if self.fallback and at - self.every - due >= self.after * DAY_MS:
                user = self.fallback
        if self.days is None or at < due + self.days * DAY_MS:
            self.document.update((workspace, filename, user, due, at, seen))
            self.handle.registerTimer(at)
        elif held:
            self.document.clear()

    def close(self) -> None:
        pass


class _Lent:
    """The state of one document among those of its bucket; its timer is the time in it."""

    def __init__(self):
        self.documents, self.name = {}, None

    def getValueState(self, name: str, schema: str) -> _Lent:
        return self

    def get(self) -> tuple | None:
        return self.documents.get(self.name)

    def update(self, document: tuple) -> None:
        self.documents[self.name] = document

    def clear(self) -> None:
        self.documents.pop(self.name, None)

    def registerTimer(self, at: int) -> None:
        pass

    deleteTimer = registerTimer


class OverdueBuckets(StatefulProcessor):
    """``OverdueProcessor`` for buckets of documents.

    Each call to the state is a round trip to the JVM and each key a group of its own. So the documents of a bucket are one
    state with one timer, read and written once a batch, and ``each`` works on them in memory.
    """

    def __init__(self, each: OverdueProcessor):
        self.each = each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.lent = handle, _Lent()
        self.bucket = handle.getValueState("bucket", BUCKET_STATE)
        self.each.init(self.lent)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        timer = self._read()
        runs = []
        for name, last in _last_changes(rows).items():
            self.lent.name = name
            runs.extend(self.each.handleInputRows((name,), (last,), timerValues))
        self._write(timer, False)
        yield from _frame(runs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        timer, now = self._read(), timerValues.getCurrentWatermarkInMs()
        runs = []
        for name in [name for name, document in self.lent.documents.items() if document[4] < now]:
            self.lent.name = name
            runs.extend(self.each.handleExpiredTimer((name,), timerValues, None))
        self._write(timer, True)
        yield from _frame(runs)

    def _read(self) -> int | None:
        held = self.bucket.get()
        self.lent.documents = {} if held is None else pickle.loads(held[1])
        return None if held is None else held[0]

    def _write(self, timer: int | None, expired: bool) -> None:
        """An expired timer is deleted by the caller."""
        documents = self.lent.documents
        soonest = min((document[4] for document in documents.values()), default=None)
        if timer is not None and soonest != timer and not expired:
            self.handle.deleteTimer(timer)
        if documents:
            self.bucket.update((soonest, pickle.dumps(documents, 5)))
            if soonest != timer:
                self.handle.registerTimer(soonest)
        elif timer is not None:
            self.bucket.clear()

    def close(self) -> None:
        pass


def _last_changes(frames: Iterable) -> dict:
    """The last change of each document of some frames of rows."""
    out = {}
    for frame in frames:
        columns = (frame[c].tolist() for c in ("key", "workspace_id", "filename", "assigned_to", "open", "due", "seen"))
        for key, workspace, filename, user, is_open, due, seen in zip(*columns):
            row = {"workspace_id": _text(workspace), "filename": _text(filename), "assigned_to": _text(user), "open": is_open,
                   "due": None if due == MISSING else due, "seen": None if seen == MISSING else seen}
            name = _text(key)
            before = out.get(name)
            if before is None or _latest(row) > _latest(before):
                out[name] = row
    return out


def _text(value) -> str | None:
    """Missing text may come as not a number."""
    return value if isinstance(value, str) else None


def _frame(runs: list[tuple]) -> Iterator:
    if runs:
        import pandas as pd

        yield pd.DataFrame(runs, columns=RUN_COLUMNS)


def notices(runs: DataFrame, fallback_user: str, after_days: int, every_ms: int) -> DataFrame:
    """The notices of each run one by one: the first after ``after_days`` whole days also reassigns the document."""
    at = F.col("at") + F.col("__k") * F.lit(every_ms)
    late = F.expr("(__at - due) div 86400000").cast("int")
    user, fallback = F.col("assigned_to"), F.lit(fallback_user)
    passes = (F.col("__at") - F.col("due") >= F.lit(after_days * DAY_MS)) & (fallback != "") & ~user.eqNullSafe(fallback)
    # The first of the run that is so late; one before the run would have reassigned it then.
    first = passes & ((F.col("__k") == 0) | (F.col("__at") - F.lit(every_ms) - F.col("due") < F.lit(after_days * DAY_MS)))
    shown = F.coalesce(F.nullif("filename", F.lit("")), F.lit("Document"))
    former = F.when(strip(F.coalesce(user, F.lit(""))) != "", user).otherwise(F.lit("unassigned"))
    days = F.concat(F.col("__late").cast("string"), F.lit("d overdue"))
    escalated = F.col("kind") == "escalated"
    spelt = (runs.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("__at", at)
             .withColumns({"__late": late, "__holder": F.when(passes & ~first, fallback).otherwise(F.nullif(user, F.lit("")))})
             .withColumn("kind", F.explode(F.when(first, F.array(F.lit("overdue"), F.lit("escalated"))).otherwise(F.array(F.lit("overdue"))))))
    return spelt.select(
        "document_id", "kind", F.timestamp_millis("__at").alias("at"), F.col("__late").alias("days_overdue"),
        F.when(escalated, fallback).otherwise(F.col("__holder")).alias("user_id"), "workspace_id",
        F.concat(F.when(escalated, F.lit("Escalated: ")).otherwise(F.lit("Overdue: ")), shown).alias("title"),
        F.when(escalated, F.concat(F.lit("Reassigned from "), former, F.lit(" to "), fallback, F.lit(" ("), days, F.lit(")"))).otherwise(days).alias("details"))


def overdue_stream(changes: DataFrame, at: str, fallback_user: str, after_days: int = ESCALATION_DAYS,
                   every_minutes: int = LOOKBACK_MINUTES, days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Notices and escalations of a stream of document rows (id, workspace_id, filename, status, due_date, assigned_to and the time ``at`` of the change).

    ``changes`` has a watermark on ``at``; event time is the clock. A document that is open at its due date gets a notice when the clock
    has passed it, and another every ``every_minutes`` while it stays open; the first notice after ``after_days`` whole days also reassigns it to
    ``fallback_user`` (none if empty). A later row of a document replaces the earlier one; a closed document, or one without a due date, is
    forgotten with its timers. ``days`` ends the notices so long after the due date, and with them the state; without it a document is kept
    while it is open.

    The state is one row for each of ``buckets`` buckets by a hash of the key, with its open documents; a task holds one bucket at a time, and a batch
    writes those that its documents or the clock touch. The number of buckets belongs to the checkpoint. Needs the RocksDB state store.
    """
    every_ms = every_minutes * 60_000
    key = F.col("id").cast("string")
    rows = changes.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), "workspace_id", "filename",
        F.nullif(F.col("assigned_to"), F.lit("")).alias("assigned_to"), (~F.coalesce(F.col("status"), F.lit("")).isin(*DONE)).alias("open"),
        *[F.coalesce(F.unix_millis(F.col(c)), F.lit(MISSING)).alias(name) for c, name in (("due_date", "due"), (at, "seen"))], F.col(at))
    runs = rows.groupBy("bucket").transformWithStateInPandas(
        OverdueBuckets(OverdueProcessor(fallback_user, after_days, every_ms, days)), RUN, "Append", "EventTime")
    return notices(runs, fallback_user, after_days, every_ms)
