import hashlib
import math
import zlib
from collections import Counter

import pytest

from clerkwise.llm.sharding import assign_shards, write_shards

from .brute import texts

ODD = [(None, "null id"), (None, None), (7, "again"), (7, "again"), (7, "other"), (-1, ""), (2**40, "ü" * 300_000)]


def shard(key, weights):
    costs = []
    for s, w in enumerate(weights):
        draw = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        costs.append((-math.log(draw) / w, s))
    return min(costs)[1]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], "doc_id long, text string, shard int, slot string, size int").repartition(3)


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 3.0, 0.5]])
def test_records_lie_where_their_draws_say(spark, weights):
    rows = [(i * 7 + 11, t) for i, t in enumerate(texts())] + ODD
    out = assign_shards(frame(spark, rows), weights).collect()
    grown = [*weights, sum(weights) / len(weights)]
    want = Counter()
    for i, t in rows:
        b, k = (t or "").encode(), "" if i is None else str(i)
        want[i, len(b) + 1, zlib.crc32(b), "key", shard(k, weights), shard(k, grown)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in out) == want
    for s in range(len(weights)):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    # The order within a shard does not depend on how the table is dealt out.
    again = assign_shards(frame(spark, rows[::-1]), weights).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_shares_follow_weights_and_few_rows_move(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    out = assign_shards(docs, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0]).collect()
    share = Counter(r["shard"] for r in out)
    assert all(abs(share[s] / 20_000 - w / 4) < 0.015 for s, w in enumerate([1, 2, 1]))
    moved = [r for r in out if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {3} and abs(len(moved) / 20_000 - 0.5) < 0.015
    # A shard less: only its own records go elsewhere.
    less = assign_shards(docs, [1.0, 2.0, 1.0], [1.0, 2.0]).collect()
    assert all(r["grown_shard"] == r["shard"] for r in less if r["shard"] < 2)


def test_odd_tables(spark):
    empty = frame(spark, ODD).limit(0)
    assert assign_shards(empty, [1.0] * 8).count() == 0
    hot = assign_shards(spark.range(500).selectExpr("cast(null AS bigint) AS doc_id", "'same' AS text"), [1.0] * 8).collect()
    assert len({r["shard"] for r in hot}) == 1 and sorted(r["slot"] for r in hot) == list(range(500))
    named = assign_shards(spark.createDataFrame([("a",), ("b",)], "name string").selectExpr("name", "name AS body"), [1.0, 1.0], key="name", text="body")
    assert {r["doc_id"]: r["shard"] for r in named.collect()} == {k: shard(k, [1, 1]) for k in "ab"}
    with pytest.raises(ValueError):
        assign_shards(empty, [1.0, 0.0])


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + ODD
    write_shards(frame(spark, rows), str(tmp_path / "out"), [1.0] * 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["__shard"], r["slot"]) for r in back.collect()) == Counter((i, t, 5, "x") for i, t in rows)
    assert all(r["shard"] == shard("" if r["doc_id"] is None else str(r["doc_id"]), [1.0] * 4) for r in back.collect())
