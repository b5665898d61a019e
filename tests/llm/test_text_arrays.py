import numpy as np
import pyarrow as pa

from clerkwise.llm import text_arrays as ta

from .brute import ALNUM, SPACE, lower, texts


def test_window_min_takes_the_first_least():
    keys = np.random.default_rng(1).integers(0, 9, 500, dtype=np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 500):
        got = ta.window_min(keys, width)
        assert got.tolist() == [i + int(np.argmin(keys[i:i + width])) for i in range(501 - width)]
    assert len(ta.window_min(keys, 501)) == 0


def test_words_and_hashes(monkeypatch):
    monkeypatch.setattr(ta, "SEGMENT_BYTES", 16)
    rows = texts()
    column = pa.array(rows, pa.string())
    for table, pattern, codes, fold in ((ta.SPACED, SPACE, ta.BYTE_CODES, str), (ta.ALNUM, ALNUM, ta.LOWER_CODES, lower)):
        data, offsets = ta.text_bytes(column.slice(3))
        starts, ends, edge = ta.word_spans(data, offsets, table)
        words = [fold(bytes(data[a:b]).decode()) for a, b in zip(starts, ends, strict=True)]
        want = [pattern.findall(fold(t or "")) for t in rows[3:]]
        assert [words[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)] == want
        hashes = ta.span_hashes(data, starts, ends, ta.Powers(), codes)
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
        pairs = ta.window_hashes(hashes, 2, ta.Powers())
        assert len(set(pairs.tolist())) == len(set(zip(words, words[1:], strict=False)))
    starts = np.arange(len(data) - 9)
    ranges = ta.range_hashes(data, starts, starts + 9, ta.Powers())
    assert len(set(ranges.tolist())) == len({bytes(data[a:a + 9]) for a in starts})


def test_slices_keep_every_row():
    column = pa.array(["a" * n for n in (5, 0, 50, 1, 1)] + [None])
    batch = pa.record_batch([column], ["text"])
    parts = list(ta.slices(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == column.to_pylist() and len(parts) == 2
