"""Texts as numpy arrays inside a task: bounded slices of a batch, word spans and rolling hashes.

Everything works on UTF-8 bytes. A slice holds at most ``SLICE_BYTES`` of text or one
longer text; hashing walks a text in segments, so scratch memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 20

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _random_table(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ascii_lower() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_set(keep) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[b for b in range(256) if keep(b)]] = True
    return table


# Words of [^\x20\x09-\x0D]+ and, after lower-casing, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = byte_set(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = byte_set(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)
BYTE_CODES = _random_table(256, 11)
LOWER_CODES = BYTE_CODES[ascii_lower()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd step and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 4096)
            for name, step in (("up", _STEP), ("down", _BACK)):
                table = np.full(n, step, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that a slice holds ``limit`` bytes of text or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.nan_to_num(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts and ends of all words, and for each row the range of its words."""
    word = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = word
    edge = offsets[(offsets >= 0) & (offsets <= len(data))]
    before[edge] = False
    starts = np.flatnonzero(after[:-1] & ~before[:-1])
    tail = after[1:].copy()
    last = edge[edge > 0] - 1
    tail[last] = False
    ends = np.flatnonzero(word & ~tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers,
                codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of every span, equal for equal bytes; spans are sorted and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(int(np.searchsorted(ends, base + SEGMENT_BYTES, "right")), at + 1)
        size = int(ends[to - 1]) - base
        powers.reach(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(codes[data[base:base + size]] * powers.up[:size], out=total[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[b] - total[a]) * powers.down[a] + (b - a).astype(np.uint64)
        at = to
    return mix(out)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Like ``span_hashes`` for ranges that may overlap; they are sorted by start."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(int(np.searchsorted(starts, base + SEGMENT_BYTES, "right")), at + 1)
        size = int(ends[at:to].max()) - base
        powers.reach(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[data[base:base + size]] * powers.up[:size], out=total[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[b] - total[a]) * powers.down[a] + (b - a).astype(np.uint64)
        at = to
    return mix(out)


def window_hashes(symbols: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive 64-bit symbols."""
    count = len(symbols) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    step = SEGMENT_BYTES
    for a in range(0, count, step):
        b = min(a + step, count)
        part = symbols[a:b + width - 1]
        powers.reach(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers.up[:len(part)], out=total[1:])
        out[a:b] = (total[width:] - total[:len(part) - width + 1]) * powers.down[:b - a]
    return mix(out)


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` keys the position of its least key, the first one on ties.

    The top 40 bits of a key order; the low 24 carry the place, so one minimum yields both.
    Block-wise prefix and suffix minima make the cost independent of ``width``.
    """
    count = len(keys) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(count, dtype=np.int64)
    low = np.uint64((1 << 24) - 1)
    for a in range(0, count, SEGMENT_BYTES):
        b = min(a + SEGMENT_BYTES, count)
        n = b - a + width - 1
        packed = np.full(n + (-n) % width, ~np.uint64(0), dtype=np.uint64)
        packed[:n] = (keys[a:a + n] & ~low) | np.arange(n, dtype=np.uint64)
        grid = packed.reshape(-1, width)
        head = np.minimum.accumulate(grid, axis=1).reshape(-1)
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out[a:b] = (np.minimum(tail[:b - a], head[width - 1:n]) & low).astype(np.int64) + a
    return out


def covered(starts: np.ndarray, length, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a span that begins at ``starts`` and has ``length`` places."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0
