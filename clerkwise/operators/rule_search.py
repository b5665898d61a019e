"""Classification and routing by a rule table of any size.

A small rule table travels inside the plan (``classify``). A larger one is dealt into blocks of bounded size, which are pressed on the executors
and lent to all tasks. A task puts as many of them together as its memory allows, searches every text for all their keywords in one walk (an
Aho-Corasick automaton) and carries the best rule so far along with the row. Texts are neither shuffled nor multiplied, and the attributes of
the chosen rule come by one equi join on its key.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.once import compute_once
from clerkwise.functions.scores import classification_confidence
from clerkwise.operators.changes import first_per_key
from clerkwise.session import broadcast_if_small, checkpointed

BLOCK_BYTES = 8 * 1024 * 1024    # of keywords in a block
FETCH_BYTES = 64 * 1024 * 1024   # of keywords whose pressed blocks come to the driver at once
PASS_BYTES = 256 * 1024 * 1024   # of pressed blocks that one pass over the rows takes
KEYWORD_COST = 64                # bytes that a keyword takes besides its text
SEARCH_CHARS = 1 << 20           # of different keywords in one automaton, which takes about 100 bytes for each
SEARCH_WORDS = 4 << 20           # of all keywords of the rules of one automaton
PAIRS = 1 << 20                  # of rows and rules that are counted at once

_STATE = {"__hits": "int", "__order": "int", "__type": "string", "__n": "int", "__matched": "array<string>"}


def rule_blocks(rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The rules that have keywords, as (rule_order, doc_type, keywords), in pressed blocks of about ``block_bytes``. A rule is never cut. One pass
    makes all blocks, and those of ``FETCH_BYTES`` are on the driver at once."""
    own = rules.filter(F.size("keywords") > 0).select("rule_order", "doc_type", "keywords")
    size = own.agg(F.sum(F.octet_length(F.array_join("keywords", "")) + KEYWORD_COST * F.size("keywords"))).first()[0] or 0
    placed = own.withColumn("block", F.pmod(F.xxhash64("doc_type", "rule_order"), F.lit(size // block_bytes + 1)))
    dealt = placed.repartition(size // FETCH_BYTES + 1, "block").sortWithinPartitions("block")
    for row in dealt.mapInArrow(_press, "pressed binary").toLocalIterator():
        yield bytes(row["pressed"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("block", "rule_order", "doc_type", "keywords"))))
    for _, block in groupby(rows, key=itemgetter(0)):
        pressed = zlib.compress(pickle.dumps([(order, kind, tuple(words)) for _, order, kind, words in block]))
        yield pa.RecordBatch.from_pydict({"pressed": pa.array([pressed], pa.binary())})


def _rank(hits: int, order: int | None, kind: str) -> tuple:
    """Least is best: most hits, then the rule that comes first, then the smaller key."""
    return -hits, order is None, order or 0, kind


def _passes(blocks: Iterator[bytes], most: int) -> Iterator[tuple[list[bytes], bool]]:
    """As many blocks together as take about ``most`` bytes, and whether they are the last."""
    held: list[bytes] = []
    for block in blocks:
        if held and sum(map(len, held)) >= most:
            yield held, False
            held = []
        held.append(block)
    if held:
        yield held, True


def _search(shared):
    """All blocks for each batch of rows. Where one searcher holds them all it is made once a task, else one at a time for each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None
        for batch in batches:
            if only is not None:
                batch = only.search(batch)
            else:
                for number, searcher in enumerate(_searchers(shared.value)):
                    batch = searcher.search(batch)
                    only = None if number else searcher
                    del searcher
            yield batch

    return run


def _searchers(packed: list[bytes]) -> Iterator[_Searcher]:
    """Searchers of as many blocks as they may hold."""
    searcher = _Searcher()
    for block in packed:
        searcher.add(pickle.loads(zlib.decompress(block)))
        if searcher.chars >= SEARCH_CHARS or len(searcher.flat) >= SEARCH_WORDS:
            yield searcher.ready()
            searcher = _Searcher()
    if searcher.sizes:
        yield searcher.ready()


class _Searcher:
    """Some rules, to be searched for in texts. Words and rules are numbered, rules in the order in which they win ties."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.orders, self.kinds, self.chars = [], [], 0
        self.sizes, self.flat = array("q"), array("q")   # keywords of each rule; their numbers, -1 for a null one

    def add(self, rules: list[tuple]) -> None:
        for _, _, words in rules:
            self.sizes.append(len(words))
            for word in words:
                if word is not None and word not in self.numbers:
                    self.numbers[word] = len(self.numbers)
                    self.chars += len(word)
                self.flat.append(-1 if word is None else self.numbers[word])
        self.orders.append(pa.array([r[0] for r in rules], pa.int64()))
        self.kinds.append(pa.array([r[1] for r in rules], pa.string()))

    def ready(self) -> _Searcher:
        import ahocorasick

        table = pa.table({"order": pa.chunked_array(self.orders, pa.int64()), "kind": pa.chunked_array(self.kinds, pa.string())})
        won = pc.sort_indices(table, sort_keys=[("order", "ascending"), ("kind", "ascending")], null_placement="at_end").to_numpy()
        self.table, self.orders, self.kinds = table.take(won).combine_chunks(), None, None
        sizes, self.flat = np.array(self.sizes, np.int64), np.array(self.flat, np.int64)
        self.rules = len(sizes)
        place = np.empty(self.rules, np.int64)
        place[won] = np.arange(self.rules)
        self.firsts, self.sizes = (np.cumsum(sizes) - sizes)[won], sizes[won]
        # The rules of each word, as often as they list it.
        listed = self.flat >= 0
        self.counts = np.bincount(self.flat[listed], minlength=len(self.numbers))
        self.starts = np.cumsum(self.counts) - self.counts
        self.owners = np.repeat(place, sizes)[listed][np.argsort(self.flat[listed], kind="stable")]
        self.words, self.empty = list(self.numbers), self.numbers.pop("", None)
        self.machine = ahocorasick.Automaton()
        for word, number in self.numbers.items():
            self.machine.add_word(word, number)
        self.machine.make_automaton()
        self.numbers = bool(self.numbers)
        return self

    def search(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        state = [batch.column(name).to_pylist() for name in _STATE]
        held, pairs = [], 0
        for row, text in enumerate(batch.column("__low").to_pylist()):
            found = {number for _, number in self.machine.iter(text)} if self.numbers and text else set()
            if self.empty is not None:
                found.add(self.empty)   # every text contains the empty keyword
            if found:
                words = np.fromiter(found, np.int64, len(found))
                held.append((row, found, words))
                pairs += int(self.counts[words].sum())
            if pairs >= PAIRS:
                self._decide(held, state)
                held, pairs = [], 0
        if held:
            self._decide(held, state)
        made = {name: pa.array(column, batch.schema.field(name).type) for name, column in zip(_STATE, state, strict=True)}
        return pa.RecordBatch.from_arrays([made.get(name, batch.column(name)) for name in batch.schema.names], schema=batch.schema)

    def _decide(self, held: list[tuple], state: list[list]) -> None:
        """The best rule of each of some rows, where it is better than what its state holds."""
        words = np.concatenate([words for _, _, words in held])
        rows = np.repeat(np.arange(len(held)), [len(words) for _, _, words in held])
        counts = self.counts[words]
        places = np.arange(counts.sum()) + np.repeat(self.starts[words] - np.cumsum(counts) + counts, counts)
        pairs = np.repeat(rows, counts) * self.rules + self.owners[places]
        pairs.sort()
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        hits = np.diff(np.append(first, len(pairs)))
        rows, rules = np.divmod(pairs[first], self.rules)
        score = hits * self.rules + (self.rules - 1 - rules)
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for at, best in zip(rows[begins].tolist(), np.maximum.reduceat(score, begins).tolist()):
            row, found, _ = held[at]
            hit, rule = divmod(best, self.rules)
            rule = self.rules - 1 - rule
            order, kind = self.table["order"][rule].as_py(), self.table["kind"][rule].as_py()
            if state[2][row] is None or _rank(hit, order, kind) < _rank(state[0][row], state[1][row], state[2][row]):
                size, start = int(self.sizes[rule]), int(self.firsts[rule])
                matched = [self.words[n] for n in self.flat[start:start + size].tolist() if n in found]
                for column, value in zip(state, (hit, order, kind, size, matched), strict=True):
                    column[row] = value


def classify_by_table(df: DataFrame, rules: DataFrame, text: str = "text", lowered: str | None = None, keywords: bool = True,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``classify``, with rules (doc_type, rule_order, keywords) of any number: doc_type, classification_confidence, matched_keywords.

    Most hits win, then the least rule_order, then the smaller key; a keyword counts as often as its rule lists it. Null texts have
    no hits but those of an empty keyword, and null keywords none. The blocks are searched in one pass over the rows, as long as they take
    about ``PASS_BYTES`` when pressed; what is beyond that takes another pass, cut by a reliable checkpoint. A stream takes all in one.
    """
    low = F.col(lowered) if lowered else F.lower(F.coalesce(F.col(text), F.lit("")))
    start = {"__low": low} | {name: F.lit(0 if name == "__hits" else None).cast(kind) for name, kind in _STATE.items()}
    context = df.sparkSession.sparkContext
    out = df.withColumns(start)
    for blocks, last in _passes(rule_blocks(rules, block_bytes), PASS_BYTES):
        shared = context.broadcast(blocks)
        out = out.mapInArrow(_search(shared), out.schema)
        if not last and not df.isStreaming:
            out = checkpointed(out)
            shared.destroy()
    made = {"doc_type": F.coalesce("__type", F.lit("other")),
            "classification_confidence": classification_confidence(F.col("__hits"), F.coalesce("__n", F.lit(1)))}
    if keywords:
        made["matched_keywords"] = F.coalesce("__matched", F.array().cast("array<string>"))
    return compute_once(out, made).drop("__low", *_STATE)


def with_attributes(df: DataFrame, rules: DataFrame, names: list[str], doc_type: str = "doc_type") -> DataFrame:
    """``df`` with ``__rule_<name>``: attributes of the rule of each row's type, those of the fallback rule for unknown types.

    An equi join on the key, broadcast where the table is measured to be small.
    """
    fallback = rules.filter("doc_type = 'other'").select(*names).first()
    side = first_per_key(rules.select("doc_type", "rule_order", *names), ["doc_type"], ["rule_order"])
    side = side.select(F.col("doc_type").alias("__rule_type"), *[F.col(n).alias(f"__own_{n}") for n in names])
    joined = df.join(broadcast_if_small(side), F.col(doc_type) == F.col("__rule_type"), "left")

    def other(name: str):
        value = fallback[name] if fallback else None
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)

    kinds = dict(rules.dtypes)
    known = F.col("__rule_type").isNotNull()
    return joined.withColumns({f"__rule_{n}": F.when(known, F.col(f"__own_{n}")).otherwise(other(n).cast(kinds[n])) for n in names}).drop(
        "__rule_type", *[f"__own_{n}" for n in names])
