import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from clerkwise.llm.inputs import vocabulary
from clerkwise.llm.packing import Encoder, pack_documents, plan_sequences, slots_by_length

from .brute import texts


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rnd = np.random.default_rng(seed)
    counts = np.zeros(101, dtype=np.int64)
    np.add.at(counts, rnd.integers(1, 101, 400), rnd.integers(1, 30, 400))
    plan = plan_sequences(counts, 100)
    used = np.zeros(101, dtype=np.int64)
    for pattern, times in plan:
        assert sum(n * c for n, c in pattern) <= 100
        for n, c in pattern:
            used[n] += c * times
    assert used.tolist() == counts.tolist()
    # No two pieces of more than half a sequence fit together.
    least = max(-(-int((counts * np.arange(101)).sum()) // 100), int(counts[51:].sum()))
    assert sum(t for _, t in plan) <= least * 1.04 + 2
    for n, (first, _, copies, _) in slots_by_length(plan, 100).items():
        assert first[0] == 0 and (np.diff(first) % copies[:-1] == 0).all() and first[-1] < counts[n]


def test_fullest_combination_is_found():
    counts = np.zeros(11, dtype=np.int64)
    counts[[7, 6, 3, 4, 2, 1]] = [1, 1, 1, 1, 0, 0]
    assert plan_sequences(counts, 10) == [([(7, 1), (3, 1)], 1), ([(6, 1), (4, 1)], 1)]
    assert plan_sequences(np.zeros(11, dtype=np.int64), 10) == []


def test_round_trip(spark):
    words = vocabulary()
    rows = [*texts(), "It's <|endoftext|> here", "naïve café 日本語 \x1c x", "word " * 500]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)] * 2, "doc_id long, text string, length string, task int")
    out = pack_documents(docs.repartition(3), **words, capacity=64, ids=True).collect()
    tokenizer = Tokenizer.from_file(words["tokenizer"])
    by_place = {}
    for r in out:
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_place.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r["piece"], r["start"], tuple(r["ids"])) for r in out if r["doc_id"] == i)
        assert pieces[::2] == pieces[1::2]
        assert [x for _, start, part in pieces[::2] for x in part] == ids
        assert all(len(part) == 64 for p, _, part in pieces if p) and (len(ids) > 64 or len(pieces) == 2)
    total = sum(r["length"] for r in out)
    assert len(by_place) <= -(-total // 64) * 1.05 + 2
    assert pack_documents(docs.limit(0), **words).count() == 0


def test_both_encoders_agree():
    words = vocabulary()
    fast, slow = Encoder(**words), Encoder(words["tokenizer"], None, None)
    for t in [*texts(3), "I'm we'll don't 'sa  \n\n  x\t\ty 123abc--?!", " lead", "trail  ", "Ünïcödé ñandú", " nbsp\u0085nel"]:
        assert fast.ids(t or "").tolist() == slow.ids(t or "").tolist()


def test_both_encoders_agree_on_a_whole_table(spark):
    words = vocabulary()
    fast, slow = Encoder(**words), Encoder(words["tokenizer"], None, None)
    for name in ("documents", "conversations", "benchmark"):
        for r in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select("text").collect():
            assert fast.ids(r["text"] or "").tolist() == slow.ids(r["text"] or "").tolist()


@pytest.mark.parametrize("seed", range(3))
def test_every_sequence_is_the_fullest_possible(seed):
    """By all sums of the lengths that are left, one sequence after the other."""
    rnd = np.random.default_rng(seed)
    counts = np.zeros(41, dtype=np.int64)
    np.add.at(counts, rnd.integers(1, 41, 25), rnd.integers(1, 9, 25))
    left = counts.copy()
    for pattern, times in plan_sequences(counts, 40):
        for _ in range(times):
            longest = int(np.flatnonzero(left).max())
            sums = {longest}
            rest = left.copy()
            rest[longest] -= 1
            for n in np.flatnonzero(rest).tolist():
                for _ in range(int(rest[n])):
                    sums |= {s + n for s in sums if s + n <= 40}
            assert pattern[0][0] == longest and sum(n * c for n, c in pattern) == max(sums)
            for n, c in pattern:
                left[n] -= c
    assert not left.any()
