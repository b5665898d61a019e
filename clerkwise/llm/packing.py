"""Packing tokenised documents into sequences by minimum bin slack.

The lengths of all pieces form a histogram of at most ``capacity`` counts, whatever the size of
the corpus. Sequences are planned on it: each starts with the longest length left and is filled
by the fullest combination of available lengths, found by subset sums over a bit set; a combination
is repeated while its lengths last. The plan is a list of patterns, and the n-th piece
of a length takes the n-th slot of that length, so no piece ever passes through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clerkwise.llm.frames import written
from clerkwise.llm.text_arrays import slices

CAPACITY = 1024
END_ID = 2


class Encoder:
    """Token ids as the tokenizer file gives them, without special tokens added.

    With ``ranks``, the same vocabulary in the other library's form, plain texts take that
    faster way; texts with anything on which two libraries might differ (a special token's
    string, control or rare characters) always take the tokenizer file's.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None) -> None:
        self.tokenizer, self.slow, self.fast = tokenizer, None, None
        self.odd = re.compile("[^\t\n\r -~¡-ɏ]|<\\|")
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.fast is not None and not self.odd.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.tokenizer)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, copies), ...], longest first, and how often each is used.

    ``counts[n]`` pieces have length n. Depends on the histogram only.
    """
    left = {n: int(c) for n, c in enumerate(counts.tolist()) if n and c}
    plan: list[tuple[list[tuple[int, int]], int]] = []
    while left:
        longest = max(left)
        room = capacity - longest
        left[longest] -= 1
        # sums[k]: bit s is set if the first k choices can add up to s.
        full, target = (1 << (room + 1)) - 1, 1 << room
        choices: list[int] = []
        sums = [1]
        for n in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
            for _ in range(min(left[n], room // n)):
                more = (sums[-1] | sums[-1] << n) & full
                if more == sums[-1]:
                    break
                choices.append(n)
                sums.append(more)
                if more & target:
                    break
            if sums[-1] & target:
                break
        left[longest] += 1
        rest = sums[-1].bit_length() - 1
        used = {longest: 1}
        for k in range(len(choices), 0, -1):
            if not sums[k - 1] >> rest & 1:
                used[choices[k - 1]] = used.get(choices[k - 1], 0) + 1
                rest -= choices[k - 1]
        times = min(left[n] // u for n, u in used.items())
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
        plan.append((sorted(used.items(), reverse=True), times))
    return plan


def slots_by_length(plan, capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length the runs of its slots: first slot, first sequence, copies per sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n, copies in pattern:
            runs.setdefault(n, []).append((filled.get(n, 0), sequence, copies, offset))
            filled[n] = filled.get(n, 0) + copies * times
            offset += n * copies
        sequence += times
    return {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}


def token_pieces(documents: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document, its ids followed by ``end_id``.

    Columns doc_id, piece, start, length, ids_crc32 (and ids if asked for), and the piece's
    place: the task that made it and its number among that task's pieces of the same length.
    Only documents that are too long are cut; all their pieces but the first are full.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + (", ids array<bigint>" if ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for part in slices(batches, "text"):
            rows, owner, lists = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                all_ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                at, piece = 0, 0
                while at < len(all_ids):
                    to = at + ((len(all_ids) - at - 1) % capacity + 1 if not piece else capacity)
                    own = all_ids[at:to]
                    rows.append((piece, at, to - at, zlib.crc32(own.tobytes()), task, seen[to - at]))
                    owner.append(i)
                    if ids:
                        lists.append(own.astype(np.int64))
                    seen[to - at] += 1
                    at, piece = to, piece + 1
            table = np.array(rows, dtype=np.int64).reshape(-1, 6)
            columns = [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(table[:, 0].astype(np.int32)),
                       *[pa.array(table[:, k]) for k in (1, 2, 3)], pa.array(table[:, 4].astype(np.int32)), pa.array(table[:, 5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int64()))] if ids else []), names + ["ids"] * ids)

    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (see ``token_pieces``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    # The numbers given inside tasks must not change any more, so the pieces are written first.
    pieces = written(pieces, "pieces")
    parts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[row["length"]] = row["n"]
    runs = spark.sparkContext.broadcast(slots_by_length(plan_sequences(counts, capacity), capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    earlier = parts.select("task", "length", F.coalesce(before, F.lit(0)).alias("earlier"))
    numbered = pieces.join(earlier, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("earlier")).drop("task", "earlier")
    names = [c for c in numbered.columns if c != "nth"]
    schema = numbered.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            length = part.column("length").to_numpy(zero_copy_only=False)
            nth = part.column("nth").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                first, start, copies, base = runs.value[n]
                run = np.searchsorted(first, nth[mine], "right") - 1
                inside = nth[mine] - first[run]
                sequence[mine] = start[run] + inside // copies[run]
                offset[mine] = base[run] + inside % copies[run] * n
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pack the texts of ``documents`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and the
    token ids with ``ids=True``. A null or empty text is one piece of the end token alone. Repeated
    rows are packed as often as they come; null ids are kept; other columns are ignored; an
    empty table gives no rows. ``tokenizer`` and ``ranks`` are files that every executor can read.
    """
    return pack(token_pieces(documents, tokenizer, ranks, pattern, capacity, end_id, ids), capacity)
