"""Benchmark decontamination with word-level suffix arrays of the training texts.

Every task sorts the suffixes of a bounded slice of the training words (a shard) and
binary-searches all test suffixes in it. Only suffixes that can hold a match are sorted: those
whose first ``shortest`` words all occur in the test texts. A hit is extended to the longest
verbatim match. Test texts travel in blocks of bounded size; more blocks mean more passes, one after
another, so any size of benchmark is searched whole. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.llm.frames import written
from clerkwise.llm.text_arrays import ALNUM, LOWER_CODES, Powers, covered, slices, span_hashes, text_bytes, word_spans

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
WINDOW = 10

MATCH = "array<struct<item_id: string, item_word: bigint, doc_word: bigint, length: bigint>>"
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())]))


@dataclass(frozen=True)
class TestBlock:
    """Words of some benchmark items. Item i has the words ``edge[i]`` to ``edge[i + 1]``."""

    items: list[str | None]
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    words: np.ndarray       # word numbers, a 0 after each item
    start: np.ndarray       # test suffixes: place in ``words``
    item: np.ndarray        # their items
    first: np.ndarray       # place of the item's first word
    need: np.ndarray        # words that must match


def _with_breaks(symbols: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` with a 0 after each row, and the place of each row's first symbol."""
    rows = len(edge) - 1
    out = np.zeros(len(symbols) + rows, dtype=np.int64)
    row = np.repeat(np.arange(rows), np.diff(edge))
    out[np.arange(len(symbols)) + row] = symbols
    return out, edge[:-1] + np.arange(rows)


def test_block(item_ids: list[str | None], texts: list[str | None], window: int) -> TestBlock:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, edge = word_spans(data, offsets, ALNUM)
    hashes = span_hashes(data, starts, ends, Powers(), LOWER_CODES)
    vocabulary = np.unique(hashes)
    words, first = _with_breaks(np.searchsorted(vocabulary, hashes) + 1, edge)
    start, item, need = [], [], []
    for i, n in enumerate(np.diff(edge).tolist()):
        wide = min(n, window)
        count = n - wide + 1 if n else 0
        start.append(first[i] + np.arange(count))
        item.append(np.full(count, i))
        need.append(np.full(count, wide))
    join = lambda parts: np.concatenate([*parts, np.zeros(0)]).astype(np.int64)
    item = join(item)
    return TestBlock(item_ids, vocabulary, words, join(start), item, first[item], join(need))


def _narrow(words: np.ndarray, suffixes: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, want: np.ndarray):
    """The part of each range [low, high) of sorted suffixes whose word at ``depth`` is ``want``."""
    bounds = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            have = words[suffixes[mid] + depth]
            less = have <= want[open_] if right else have < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        bounds.append(a)
    return bounds


def search_shard(data: np.ndarray, offsets: np.ndarray, block: TestBlock, powers: Powers):
    """Maximal matches in one shard: row, word in the row, item, word in the item, length; and words per row."""
    starts, ends, edge = word_spans(data, offsets, ALNUM)
    count = np.diff(edge)
    none = np.zeros(0, dtype=np.int64)
    if not len(block.start) or not len(starts):
        return count, (none,) * 5
    hashes = span_hashes(data, starts, ends, powers, LOWER_CODES)
    place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    numbers = np.where(block.vocabulary[place] == hashes, place + 1, 0)
    words, first = _with_breaks(numbers, edge)
    deepest, shortest = int(block.need.max()), int(block.need.min())
    words = np.concatenate([words, np.zeros(deepest, dtype=np.int64)])
    # Suffix array of the shard, to the depth of the longest window, over the suffixes that can match.
    foreign = np.concatenate([[0], np.cumsum(words == 0)])
    suffixes = np.flatnonzero(foreign[shortest:] == foreign[:-shortest])
    bits = int(len(block.vocabulary)).bit_length()
    each = max(1, 62 // bits)
    columns = []
    for at in range(0, deepest, each):
        key = np.zeros(len(suffixes), dtype=np.int64)
        for d in range(at, min(at + each, deepest)):
            key = (key << bits) | words[np.minimum(suffixes + d, len(words) - 1)]
        columns.append(key)
    suffixes = suffixes[np.lexsort(columns[::-1])] if len(suffixes) else none
    # Binary search, one word deeper each time; suffixes of the test texts drop out when their range is empty.
    live = np.arange(len(block.start))
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(suffixes), dtype=np.int64)
    found = []
    for depth in range(deepest):
        low, high = _narrow(words, suffixes, depth, low, high, block.words[block.start[live] + depth])
        some = low < high
        live, low, high = live[some], low[some], high[some]
        done = block.need[live] == depth + 1
        found.append((live[done], low[done], high[done]))
        live, low, high = live[~done], low[~done], high[~done]
        if not len(live):
            break
    query, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    times = high - low
    query = np.repeat(query, times)
    order = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
    at = suffixes[np.repeat(low, times) + order] if len(query) else none
    # Only matches that cannot start earlier; the others are parts of them.
    test = block.start[query]
    fresh = (test == block.first[query]) | (at == 0) | (words[at - 1] != block.words[test - 1]) | (words[at - 1] == 0)
    query, at, test = query[fresh], at[fresh], test[fresh]
    length = block.need[query].copy()
    going = np.arange(len(query))
    while len(going):
        x, y = at[going] + length[going], test[going] + length[going]
        same = (words[np.minimum(x, len(words) - 1)] == block.words[y]) & (block.words[y] != 0)
        going = going[same]
        length[going] += 1
    row = np.searchsorted(first, at, "right") - 1
    return count, (row, at - first[row], block.item[query], test - block.first[query], length)


def _blocks(benchmark: DataFrame, window: int, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[TestBlock, bool]]:
    """The benchmark in blocks and whether each is the last; each is collected by itself and is bounded by about ``block_bytes``."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // block_bytes + 1
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else rows
        found = sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda f: (f[0] is None, f[0] or "", f[1]))
        yield test_block([i for i, _ in found], [t for _, t in found], window), k == count - 1


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark items occur in documents.

    One row per row of ``documents``: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    window of ``window`` item words; a shorter item is one window), ``items`` (sorted ids of the
    items found, as text) and ``matches`` (longest verbatim matches with their places). Words
    are runs of digits, letters a-z in any case and non-ASCII characters.

    Null or empty texts have no words and no matches; items with a null text are not searched, and those
    with a null id are left out of ``items`` only; repeated rows and ids are kept as they are; other columns are ignored.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                             F.array().cast(MATCH).alias("matches"))
    def search(shared, last):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, powers = TestBlock(**shared.value), Powers()
            for part in slices(batches, "text", SHARD_BYTES):
                data, offsets = text_bytes(part.column("text"))
                words, (row, at, item, place, length) = search_shard(data, offsets, block, powers)
                matches = part.column("matches")
                if len(row):
                    lists = matches.to_pylist()
                    for r, x, i, p, n in zip(row.tolist(), at.tolist(), item.tolist(), place.tolist(), length.tolist(), strict=True):
                        lists[r] = [*(lists[r] or []), {"item_id": block.items[i], "item_word": p, "doc_word": x, "length": n}]
                    matches = pa.array(lists, MATCH_ARROW)
                if not last:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), matches], ["doc_id", "text", "matches"])
                    continue
                hit, items = np.zeros(part.num_rows, dtype=np.int64), [[] for _ in range(part.num_rows)]
                for r in np.flatnonzero(pc.list_value_length(matches).fill_null(0).to_numpy(zero_copy_only=False)):
                    mine = matches[int(r)].as_py()
                    hit[r] = covered(np.array([m["doc_word"] for m in mine]), np.array([m["length"] for m in mine]), int(words[r])).sum()
                    items[r] = sorted({m["item_id"] for m in mine} - {None})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words), pa.array(hit), pa.array(items, pa.list_(pa.string())), matches],
                    ["doc_id", "n_words", "n_hit", "items", "matches"])
        return work

    for block, last in _blocks(benchmark, window, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(vars(block))
        schema = f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, matches {MATCH}" if last else f"doc_id {kind}, text string, matches {MATCH}"
        frame = frame.mapInArrow(search(shared, last), schema)
        if not last:
            # One pass after another, so that only one block is held at a time.
            frame = written(frame, "searched")
            shared.destroy()
    return frame


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that hold no window of a benchmark item.

    Null and empty texts hold none and stay; null and repeated ids make no difference, each row is judged by its text. Items of a null text are
    not searched, items of a null id are. Columns of any other names pass through; an empty table gives no rows, and an empty benchmark takes none away.
    """
    spark = documents.sparkSession

    def clean(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, powers = TestBlock(**shared.value), Powers()
            for part in slices(batches, text, SHARD_BYTES):
                data, offsets = text_bytes(part.column(text))
                _, (row, *_rest) = search_shard(data, offsets, block, powers)
                keep = np.ones(part.num_rows, dtype=bool)
                keep[row] = False
                yield part.filter(pa.array(keep))
        return work

    for block, last in _blocks(benchmark, window, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(vars(block))
        documents = documents.mapInArrow(clean(shared), documents.schema)
        if not last:
            documents = written(documents, "searched")
            shared.destroy()
    return documents
