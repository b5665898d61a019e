"""Repairing the structure of conversations by an auction on the lattice of edits.

A conversation shall read `(s?(ua)+)?` by the initials of its roles. Its edits are arcs of a lattice: a node
is a place between two rows and what has been said so far (nothing, system, user, assistant); deleting, keeping or re-roling a row leads
to the next place, inserting an empty turn stays at it. The auction keeps a price for every node, a lower bound of the cost from there on.
It holds a path from the start: if no arc of the path's last node is tight, that is, if its price is below every arc's cost plus the
price behind it, the price rises to the least of these and the path is shortened by that node; else the path follows the tight arc. When it reaches
the end, the arcs of every cheapest path are tight, and a search along tight arcs in the order of their letters meets the least audit first.

Conversations are cut into segments of bounded length that are worked on side by side: the auction gives the cost between
any two states of a segment, a pass over these small tables from the last segment to the first gives the price at every cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import written
from clerkwise.session import number_rows

SEGMENT = 64
NEVER = 1 << 40
# What has been said so far.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}   # the state after an inserted or re-roled turn
ENDS = [0, NEVER, NEVER, 0]                                             # a conversation ends with nothing or with the assistant
DELETE, INSERT, REROLE = 3, 2, 2
SPACES = " \t\n\x0b\f\r"
# Codes of rows: the role's initial, then the first fault.
INITIALS, FAULTS = "sua-", ("none", "truncated", "blank", "duplicate")
LEGAL = {"su", "ua", "au"}


def code_of(initial: str, fault: str) -> str:
    return chr(ord("A") + INITIALS.index(initial) * len(FAULTS) + FAULTS.index(fault))


Arcs = tuple[tuple[tuple[str, int, int, int], ...], ...]


def arcs(code: str) -> Arcs:
    """For each state the edits (letter, places on, state, cost) before or at a row of this code, in the order of their letters."""
    initial, fault = divmod(ord(code) - ord("A"), len(FAULTS))
    late = int(FAULTS[fault] == "truncated")
    out = []
    for state in range(STATES):
        after = NEXT[state]
        mine = [("D", 1, state, DELETE), ("I", 0, after, INSERT)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            fits = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
            kept = fits.get((state, INITIALS[initial]))
            if kept is not None:
                mine.append(("K", 1, kept, late))
            mine.append(("R", 1, after, REROLE + late))
        out.append(tuple(mine))
    return tuple(out)


ARCS: dict[str, Arcs] = {c: arcs(c) for c in (code_of(i, f) for i in INITIALS for f in FAULTS)}
# What a row costs at least, whatever stands before it.
LEAST = {c: min(cost for state in found for _, on, _, cost in state if on) for c, found in ARCS.items()}


class Lattice:
    """The lattice of one segment and the prices of an auction towards its end.

    ``exits`` is the cost still to come for each state at the end. Only the last segment of a conversation may
    insert at its end: elsewhere that is the start of the next.
    """

    def __init__(self, codes: str, exits: list[int], last: bool, states: tuple[int, ...] = (0, 1, 2, 3)) -> None:
        self.size, self.exits = len(codes), exits
        self.rows = [ARCS[c] for c in codes]
        self.rows.append(tuple((("I", 0, NEXT[q], INSERT),) if last else () for q in range(STATES)))
        # A feasible start: the rows' least costs and the least exit. States that cannot reach the end never become cheaper.
        floor = min(exits)
        self.price = [NEVER] * (STATES * (self.size + 1))
        for place in range(self.size, -1, -1):
            for q in states:
                self.price[STATES * place + q] = floor
            floor += LEAST[codes[place - 1]] if place else 0

    def auction(self, state: int) -> int:
        """Raise prices until the path from ``state`` at the start reaches the end; returns its cost."""
        price, rows, size, exits = self.price, self.rows, self.size, self.exits
        path = [state]
        while True:
            node = path[-1]
            place, q = node >> 2, node & 3
            # At the end of the segment the arc out of the lattice comes first.
            best, to = (exits[q], -1) if place == size else (NEVER, -1)
            for _, on, then, cost in rows[place][q]:
                j = node - q + STATES * on + then
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if best >= NEVER and price[node] >= NEVER:
                raise ValueError("no way from this state")
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                return price[state]
            else:
                path.append(to)

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters of the cheapest edits after an auction from ``state``, and the state they end in."""
        price, dead = self.price, set()
        path, letters = [(state, iter(self._tight(state)))], []
        while True:
            node, more = path[-1]
            for letter, j in more:
                if j < 0:
                    return "".join(letters), node & 3
                if j not in dead:
                    path.append((j, iter(self._tight(j))))
                    letters.append(letter)
                    break
            else:
                dead.add(node)
                path.pop()
                letters.pop()

    def _tight(self, node: int) -> list[tuple[str, int]]:
        place, q = node >> 2, node & 3
        out = [("", -1)] if place == self.size and self.exits[q] == self.price[node] else []
        for letter, on, then, cost in self.rows[place][q]:
            j = node - q + STATES * on + then
            if self.price[j] < NEVER and cost + self.price[j] == self.price[node]:
                out.append((letter, j))
        return out


def costs_between(codes: str, last: bool) -> list[int]:
    """Cheapest cost from each state at the segment's start (rows of four) to each state at its end."""
    out = [NEVER] * (STATES * STATES)
    system = any(INITIALS.index("s") * len(FAULTS) <= ord(c) - ord("A") < INITIALS.index("s") * len(FAULTS) + 2 for c in codes)
    for end in range(STATES):
        # Nothing and system are left for good, and a system turn is said by a row that is kept.
        states = {NOTHING: (NOTHING,), SYSTEM: (NOTHING, SYSTEM) if system else (SYSTEM,)}.get(end, (0, 1, 2, 3))
        lattice = Lattice(codes, [0 if q == end else NEVER for q in range(STATES)], last, states)
        for start in states:
            out[STATES * start + end] = lattice.auction(start)
    return out


def edits_from(codes: str, exits: list[int], last: bool, starts: tuple[int, ...]) -> list[tuple[int, str, int] | None]:
    """For each state at the segment's start the cost up to the conversation's end, the letters and the state at the segment's end."""
    lattice, out = Lattice(codes, exits, last), [None] * STATES
    for start in starts:
        cost = lattice.auction(start)
        out[start] = (cost, *lattice.trace(start))
    return out


def counts(codes: str, before: str = "") -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows and illegal neighbours; ``before`` is the initial of the row before."""
    numbers = [ord(c) - ord("A") for c in codes]
    fault = [n % len(FAULTS) for n in numbers]
    initials = before + "".join(INITIALS[n // len(FAULTS)] for n in numbers)
    illegal = sum(initials[k:k + 2] not in LEGAL for k in range(len(initials) - 1))
    return (*(fault.count(FAULTS.index(f)) for f in ("blank", "duplicate", "truncated")), illegal)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn`; a null counts as one space there, in role and in text.

    Of twenty rows one is dropped, one loses its text, one its `.`, `!` and `?`, one is repeated, and one becomes the user's.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("times").alias("time")).drop("time")


ORDER = ["turn", "role", "hash", "hash2"]


def _read(conversations: DataFrame) -> DataFrame:
    """Rows in the form that all steps use: group (conv_id as text, empty for a null), ORDER, text and code without duplicates."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("group"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.select("group", "turn", "role", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit("again"), "text").alias("hash2"), "text")


def _segments(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """Segments (group, segment, codes, n) with n rows in their conversation, and group, gaps of every conversation."""
    body = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    short = rows.select("group", *ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), (body == "").alias("blank"),
                        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"), F.monotonically_increasing_id().alias("row"))
    # Rows alike in all else are numbered by their place in the table, so that even a row repeated without end is dealt out.
    numbered = written(number_rows(short, [*ORDER, "row"], "nth", ["group"]).drop("row"), "numbered")
    firsts = numbered.groupBy("group", "role", "hash", "hash2").agg(F.min("nth").alias("nth")).select("group", "nth", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated").otherwise("none"))
    code = F.chr(F.lit(ord("A")) + (F.instr(F.lit(INITIALS), F.col("initial")) - 1) * len(FAULTS)
                 + F.array_position(F.array(*[F.lit(f) for f in FAULTS]), fault) - 1)
    coded = numbered.join(firsts, ["group", "nth"], "left").select("group", "nth", code.alias("code"))
    pieces = coded.groupBy("group", F.floor((F.col("nth") - 1) / segment).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("nth", "code"))).alias("rows"))
    turns = numbered.groupBy("group").agg(F.count(F.lit(1)).alias("n"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    whole = written(turns.select("group", "n", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps")), "turns")
    codes = pieces.select("group", "segment", F.array_join("rows.code", "").alias("codes")).join(whole.select("group", "n"), "group")
    return written(codes, "codes"), whole.select("group", "gaps")


def _prices(pieces: DataFrame, segment: int) -> DataFrame:
    """The cost still to come (exits, one for each state) at the end of every segment of the conversations of several."""
    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names, places, codes, sizes = (part.column(c).to_pylist() for c in ("group", "segment", "codes", "n"))
            found = [costs_between(c, (s + 1) * segment >= n) for c, s, n in zip(codes, places, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                             ["group", "segment", "costs"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ahead = None, ENDS
        for part in batches:
            names, costs = part.column("group").to_pylist(), part.column("costs").to_pylist()
            out = []
            for name, table in zip(names, costs, strict=True):
                if name != held:
                    held, ahead = name, ENDS
                out.append(ahead)
                ahead = [min(min(table[STATES * q + e] + ahead[e] for e in range(STATES)), NEVER) for q in range(STATES)]
            yield pa.RecordBatch.from_arrays([part.column("group"), part.column("segment"), pa.array(out, pa.list_(pa.int64()))], ["group", "segment", "exits"])

    long = pieces.where(F.col("n") > segment)
    tables = long.mapInArrow(between, "group string, segment bigint, costs array<bigint>")
    return (tables.repartition("group").sortWithinPartitions("group", F.col("segment").desc())
            .mapInArrow(backwards, "group string, segment bigint, exits array<bigint>"))


EDITS = "group string, segment bigint, codes string, costs array<bigint>, letters array<string>, ends array<int>"


def _edits(pieces: DataFrame, segment: int) -> DataFrame:
    """For every segment and state at its start the cost up to the conversation's end, the letters and the state at the segment's end."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names, places, codes, sizes, exits = (part.column(c).to_pylist() for c in ("group", "segment", "codes", "n", "exits"))
            out = [[], [], []]
            for c, s, n, ahead in zip(codes, places, sizes, exits, strict=True):
                found = edits_from(c, ahead or ENDS, (s + 1) * segment >= n, (0, 1, 2, 3) if s else (NOTHING,))
                for k, column in enumerate(out):
                    column.append([f and f[k] for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(codes, pa.string()), pa.array(out[0], pa.list_(pa.int64())),
                 pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int32()))], ["group", "segment", "codes", "costs", "letters", "ends"])

    priced = pieces.join(_prices(pieces, segment), ["group", "segment"], "left")
    return priced.select("group", "segment", "codes", "n", "exits").mapInArrow(work, EDITS)


class _Conversation:
    """One conversation in the making: its edits first, then its rows one at a time."""

    def __init__(self, group: str) -> None:
        self.group, self.state, self.cost, self.found = group, NOTHING, None, np.zeros(4, np.int64)
        self.letters: list[str] = []
        self.last, self.audit, self.at, self.said = "", None, 0, NOTHING

    def edits(self, codes: str, costs: list, letters: list, ends: list) -> None:
        self.cost = costs[self.state] if self.cost is None else self.cost
        self.found += counts(codes, self.last)
        self.last = INITIALS[(ord(codes[-1]) - ord("A")) // len(FAULTS)]
        self.letters.append(letters[self.state])
        self.state = ends[self.state]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.said = NEXT[self.said]
            yield "I", "user" if self.said == USER else "assistant", ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired turns (letter, role, text) up to and with this row."""
        if self.audit is None:
            self.audit = "".join(self.letters)
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.said = {"s": SYSTEM, "u": USER}.get(role[0], ASSISTANT)
            yield letter, role, text
        elif letter == "R":
            self.said = NEXT[self.said]
            yield letter, "user" if self.said == USER else "assistant", text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _together(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's edits and then its rows in order. The only step that shuffles texts."""
    left = edits.select("group", F.lit(0).alias("part"), "segment", *[F.lit(None).cast(k).alias(c) for c, k in
                        (("turn", "bigint"), ("role", "string"), ("hash", "bigint"), ("hash2", "bigint"), ("text", "string"))], "codes", "costs", "letters", "ends")
    right = rows.select("group", F.lit(1).alias("part"), F.lit(None).cast("bigint").alias("segment"), *ORDER, "text",
                        *[F.lit(None).cast(k).alias(c) for c, k in (("codes", "string"), ("costs", "array<bigint>"), ("letters", "array<string>"), ("ends", "array<int>"))])
    return left.unionByName(right).repartition("group").sortWithinPartitions("group", "part", "segment", *ORDER)


def _walk(batches: Iterator[pa.RecordBatch], on_turn, on_end) -> Iterator[tuple]:
    """Results of ``on_turn(conversation, turn)`` and ``on_end(conversation)`` over all conversations, one row at a time."""
    now = None
    for batch in batches:
        for group, part, role, text, codes, costs, letters, ends in zip(
                *[batch.column(c).to_pylist() for c in ("group", "part", "role", "text", "codes", "costs", "letters", "ends")], strict=True):
            if now is None or now.group != group:
                if now is not None:
                    for turn in now.rest():
                        yield from on_turn(now, turn)
                    yield from on_end(now)
                now = _Conversation(group)
            if not part:
                now.edits(codes, costs, letters, ends)
                continue
            for turn in now.row(role, text):
                yield from on_turn(now, turn)
    if now is not None:
        for turn in now.rest():
            yield from on_turn(now, turn)
        yield from on_end(now)


def _portions(rows: Iterator[tuple], kinds: dict[str, pa.DataType], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of characters, or one row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, object] = {}

    def on_turn(now: _Conversation, turn: tuple) -> Iterator[tuple]:
        if now.group not in sums:
            sums[now.group] = hashlib.sha256()
        else:
            sums[now.group].update(b"\n")
        for piece in (turn[1], ":", turn[2]):
            sums[now.group].update(piece.encode())
        return iter(())

    def on_end(now: _Conversation) -> Iterator[tuple]:
        done = sums.pop(now.group, None) or hashlib.sha256()
        blank, duplicate, truncated, illegal = now.found.tolist()
        yield now.group, blank, duplicate, truncated, illegal, now.cost, now.audit, done.hexdigest()

    whole = pa.int64()
    yield from _portions(_walk(batches, on_turn, on_end), {"group": pa.string(), "blank": whole, "duplicate": whole, "truncated": whole, "illegal": whole,
                                                          "cost": whole, "audit": pa.string(), "repaired_sha256": pa.string()})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place: dict[str, int] = {}

    def on_turn(now: _Conversation, turn: tuple) -> Iterator[tuple]:
        place[now.group] = place.get(now.group, -1) + 1
        yield now.group, place[now.group], *turn

    def on_end(now: _Conversation) -> Iterator[tuple]:
        place.pop(now.group, None)
        return iter(())

    yield from _portions(_walk(batches, on_turn, on_end), {"group": pa.string(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()})


def _named(conversations: DataFrame) -> DataFrame:
    """conv_id and group of every conversation."""
    return conversations.select("conv_id").distinct().select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("group"))


def audit_conversations(conversations: DataFrame, every: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``conversations`` (conv_id, turn, role, text).

    One row for each conv_id, and for each of ``every`` (a table with conv_id) that has no rows: gaps (turns missing between the first and the last),
    blank, duplicate, truncated (rows by first fault), illegal (neighbours whose role initials are not su, ua or au), cost, audit (the letters of
    the edits) and repaired_sha256 (of the repaired `role:text` lines). Delete costs 3, insert and re-role 2, keep nothing; a truncated row
    that stays costs one more; blank and duplicate rows are deleted. Of equally cheap repairs the audit least in ASCII counts.

    Rows are taken by turn, nulls first; rows of one turn by role and a hash of their text, so repeated rows follow each other. A null role or text
    counts as one space, a null conv_id is a conversation, null turns are left out of gaps. Other columns are ignored; an empty table gives no rows but those
    of ``every``. Texts are hashed in full (128 bits) to find duplicates, and shuffled once.

    A conversation may be of any length: it is cut into segments of ``segment`` rows for the auction. Only the digest of its text
    is one task's work, one row at a time, since SHA-256 has no other way; its audit is one string, a letter for each edit.
    """
    rows = _read(conversations)
    pieces, gaps = _segments(rows, segment)
    found = _together(rows, _edits(pieces, segment)).mapInArrow(
        _digest, "group string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    names = _named(conversations if every is None else conversations.select("conv_id").unionByName(every.select("conv_id")))
    out = names.join(found.join(gaps, "group"), "group", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role, text. Rules and odd rows as in ``audit_conversations``."""
    rows = _read(conversations)
    pieces, _ = _segments(rows, segment)
    turns = _together(rows, _edits(pieces, segment)).mapInArrow(_turns, "group string, place bigint, edit string, role string, text string")
    return turns.join(_named(conversations), "group").select("conv_id", "place", "edit", "role", "text")
