import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clerkwise.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score int, slot string"


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    """Plain Python, one pair at a time."""
    fine = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, label, [math.floor(scale * float(np.float32(x))) for x in v]))

    def order(found):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))

    out = Counter()
    for n, (i, label, v) in enumerate(fine):
        if i is None or i % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for m, (j, other, w) in enumerate(fine) if m != n]
        for score, j, _ in order([s for s in scores if s[2] == label])[:positives]:
            inside = [s for s in scores if s[2] != label and low * score <= 100 * s[0] <= high * score]
            for rank, (less, k, _) in enumerate(order(inside)[:negatives], 1):
                out[i, j, rank, k, score, less] += 1
    return out


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(i, x, v, 1, "y") for i, x, v in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in hn.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0, **more).collect())


def vectors(n=400, width=12, seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.5) for _ in range(width)] for _ in range(4)]
    rows = [(i * 25, rnd.randrange(3), [c + rnd.gauss(0, 0.2) for c in centres[rnd.randrange(4)]]) for i in range(n)]
    rows += [rows[k] for k in range(0, 40, 4)]                                     # repeated rows, anchors among them
    rows += [(100, 1, rows[3][2]), (100, 2, rows[9][2])]                           # one id, other vectors
    rows += [(10_000 + i, i % 3, rows[4][2]) for i in range(60)]                   # many equal vectors: ties
    rows += [(None, 0, rows[0][2]), (None, 1, rows[0][2]), (300, None, rows[0][2]), (400, 1, None), (500, 1, [1.0, None]),
             (600, 1, [float("nan")] * width), (700, 2, [float("inf")] * width), (800, 1, [0.0] * width), (900, 2, []), (1000, 1, rows[0][2][:5])]
    return rows


@pytest.mark.parametrize("more", [{}, {"block": 7}, {"positives": 2, "negatives": 3, "low": 50, "high": 95}])
def test_equal_to_pairs_one_by_one(spark, more):
    rows = vectors()
    got, want = mined(spark, rows, **more), brute(rows, **{k: v for k, v in more.items() if k != "block"})
    assert got == want and sum(got.values()) > 200


def test_small_tiles_give_the_same(spark, monkeypatch):
    rows = vectors(120)
    monkeypatch.setattr(hn, "TILE", 16)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("width, size", [(1, 3), (64, 256), (64, 1 << 20), (200, 1 << 24), (70, 1 << 10)])
def test_products_are_exact(width, size):
    random_ = np.random.default_rng(width)
    left = random_.integers(-size, size + 1, (9, width))
    right = np.concatenate([random_.integers(-size, size + 1, (11, width)), np.full((1, width), size), np.full((1, width), -size)])
    left[0] = size
    moduli = hn.primes(width * size * size)
    assert all(hn.DEPTH * (p // 2) ** 2 <= hn.EXACT for p in moduli)
    got = hn.products([hn.residues(left, p) for p in moduli], [hn.residues(right, p) for p in moduli], moduli)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in right] for a in left]


def test_odd_tables(spark):
    for rows in ([], [(100, 1, [0.5, 0.5])], [(7, 1, [0.5]), (8, 2, [0.5])], [(100, None, [0.5]), (8, 2, [0.5])], [(100, 1, []), (200, 1, []), (3, 2, [])]):
        assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        mined(spark, [(100, 1, [1e30]), (1, 2, [1.0])])
