"""The operators with one right answer, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clerkwise.llm import near_duplicates as nd
from clerkwise.llm import registry
from clerkwise.llm.blocks import block_pairs
from clerkwise.llm.components import components
from clerkwise.llm.contamination import contamination, drop_contaminated
from clerkwise.llm.frames import join_one
from clerkwise.llm.line_windows import drop_repeated_lines
from clerkwise.llm.near_duplicates import keep_one_of_each, near_duplicates
from clerkwise.llm.passages import drop_repeated_passages
from clerkwise.llm.substrings import drop_repeated_bytes

from . import brute

DOCS = [(i, t) for i, t in enumerate(brute.texts())]
ODD = "doc_id long, text string, __slot int, node string, n_words string, lines int"


@pytest.fixture(scope="module")
def docs(spark):
    """With other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "n", None, 3) for i, t in DOCS], ODD).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: str(r[0]).zfill(9))


def test_contamination(spark, docs, none):
    words = [t.split() for _, t in DOCS if t and len(t.split()) > 30]
    items = [("i1", " ".join(words[0][3:20])), ("i2", " ".join(words[1][:4])), ("i2", " ".join(words[2][:12])), ("i3", ""), (None, "a"), ("i4", None),
             ("i5", "A"), ("i6", " ".join(words[3][5:15]).upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.contamination(DOCS, [i for i in items if i[0] is not None])
    for block in (1 << 20, 150):
        got = contamination(docs, bench, block_bytes=block)
        assert rows(got, "doc_id", "n_words", "n_hit", "items") == want
    left = drop_contaminated(docs, bench, block_bytes=150)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [w[0] for w in want if not w[2]]
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y"), (1, "x a b c d e y")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "q a b c d e r")], "item_id int, text string")
    found = contamination(docs, bench, window=3).collect()
    assert [[tuple(m) for m in r["matches"]] for r in found] == [[("7", 1, 1, 5)]] * 2


def test_lines(docs, none, spark):
    got = drop_repeated_lines(docs)
    assert rows(got, "doc_id", "text", "n_lines", "n_removed") == brute.lines(DOCS)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert drop_repeated_lines(none).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id int, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in drop_repeated_lines(twice).collect()) == [
        ("1", ""), ("1", ""), ("2", "d"), ("None", "a\nb\nc")]


def test_passages(spark, docs, none):
    for edge, seed in ((4, 2), (12, 5)):
        got = drop_repeated_passages(docs, edge, seed)
        assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.passages(DOCS, edge)
    assert drop_repeated_passages(none).count() == 0
    odd = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "x a b c")], "doc_id int, text string")
    got = drop_repeated_passages(odd, 3, 2)
    assert rows(got, "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 3), (None, 0)]


def test_passages_of_repeated_ids(spark):
    """Every row is a document of its id: 20 loses what also starts in 9, whichever texts id 5 has besides."""
    a, b = " ".join(f"a{k}" for k in range(8)), " ".join(f"b{k}" for k in range(8))
    for one, two in ((a, b), (b, a)):
        odd = [(5, one), (5, two), (9, two), (20, f"x {two} y"), (20, f"{one} z"), (30, "u v w"), (30, "u v w"), (31, "u v w")]
        got = drop_repeated_passages(spark.createDataFrame(odd, "doc_id int, text string"), 3, 2)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(brute.passages(odd, 3))
    many = [(i % 4, t) for i, (_, t) in enumerate(DOCS)] + [(7, t) for _, t in DOCS[:20]]
    got = drop_repeated_passages(spark.createDataFrame(many, "doc_id int, text string").repartition(3), 4, 2)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(brute.passages(many, 4))


def test_joins_deal_out_hot_keys(spark):
    rows_ = spark.range(60_000).selectExpr("if(id % 3 = 0, -1, id % 500) AS key", "id AS x", "'r' AS name")
    ones = rows_.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.max("x").alias("greatest"))
    got = join_one(rows_.withColumn("__part", F.lit("own")).drop("__part"), ones, "key").agg(
        F.count(F.lit(1)), F.countDistinct("x"), F.sum(F.expr("if(greatest >= x, 1, 0)"))).first()
    assert tuple(got) == (60_000, 60_000, 60_000)


def test_substrings(spark, docs, none):
    for length, seed, levels in ((12, 4, (4, 2, 1)), (20, 7, (8, 1))):
        got = drop_repeated_bytes(docs, length, seed, levels)
        assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(DOCS, length)
    assert drop_repeated_bytes(none).count() == 0
    odd = spark.createDataFrame([(None, "abcdefgh"), (None, "abcdefgh"), (1, "xabcdef"), (1, "y")], "doc_id int, text string")
    got = drop_repeated_bytes(odd, 6, 2, (2, 1))
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 6, 8, 8]


def test_near_duplicates(spark, docs, none):
    want = brute.near(DOCS)
    for rounds, hot in ((3, 1000), (1, 2)):
        got = near_duplicates(docs, rounds, hot)
        assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == want
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [w[0] for w in want if w[3]]
    assert near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "c d"), (3, "A b"), (3, "A b"), (4, None)], "doc_id int, text string")
    got = sorted(((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_duplicates(odd).collect()), key=str)
    assert got == [("3", 3, True), ("3", 3, True), ("4", 4, True), ("None", 3, False), ("None", None, True)]
    assert sorted(str(r["doc_id"]) for r in keep_one_of_each(odd).collect()) == ["3", "4", "None"]


def test_one_row_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(120)]
    near = [" ".join([*words[:k], "edit", *words[k:]]) for k in (3, 60, 110)]
    odd = [(None, t) for t in near] + [(7, "other text of five words"), (7, "Other text of five words"), (None, ""), (None, None), (8, "")]
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in odd], "doc_id int, text string, node string, root int")
    kept = [(r["doc_id"], r["text"]) for r in keep_one_of_each(frame).collect()]
    assert len(kept) == 5 and sum(i is None and t in near for i, t in kept) == 1 and sum(i == 7 for i, t in kept) == 1
    assert {(None, ""), (None, None), (8, "")} <= set(kept)
    assert keep_one_of_each(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 9] + [(100, i) for i in range(60, 90)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in sorted(links):
        if a != b:
            want.setdefault(a, a)
    for n in range(0, 41):
        start = next((s for s in range(n, -1, -1) if s == 0 or (s - 1) % 9 == 0), 0)
        if n in got:
            assert got[n] == start
    assert {got[i] for i in [*range(60, 90), 100]} == {60} and set(want) <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_groups_stay_whole(spark):
    """Many near copies and exact copies of one text, and a passage that all texts share."""
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base[:i % 60], "edit", *base[i % 60:]]) for i in range(120)] + [" ".join(base)] * 50
    texts += [" ".join([f"o{i}x{k}" for k in range(30)] + base[:20]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = rows(near_duplicates(docs, hot=20).select(F.col("doc_id"), "n_shingles", "component_id", "kept"), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(list(enumerate(texts)))


def test_no_group_holds_more_than_two_blocks(spark):
    """Entries of any size: every pair of different roots meets in one group, and blocks of one root are not compared."""
    roots = [5] * 40 + list(range(100, 123)) + [7] * 20
    members = spark.createDataFrame([(k, n, r) for k in (1, 2) for n, r in enumerate(roots)], "key long, node long, root long")
    groups = {}
    for r in block_pairs(members, 8).collect():
        groups.setdefault((r["key"], r["low"], r["high"]), []).append(r)
    assert max(map(len, groups.values())) <= 16
    met = []
    for (key, low, high), rows_ in groups.items():
        assert len({r["root"] for r in rows_}) > 1
        met += [(key, *sorted((x["node"], y["node"]))) for k, x in enumerate(rows_) for y in rows_[:k]
                if x["root"] != y["root"] and (low == high or x["block"] != y["block"])]
    want = {(k, a, b) for k in (1, 2) for b in range(len(roots)) for a in range(b) if roots[a] != roots[b]}
    assert len(met) == len(set(met)) and set(met) == want


def test_a_pair_of_one_shared_chunk_meets_in_a_large_entry(spark):
    """Two signatures within the distance that share chunk 0 only, among many members of its entries."""
    signs = np.random.default_rng(1).integers(0, 1 << 16, (40, nd.PLACES + nd.SKETCH // 16)).astype("<u2")
    signs[:, :nd.CHUNK] = signs[0, :nd.CHUNK]
    signs[1] = signs[0]
    differ = [c + k for c in range(nd.CHUNK, nd.PLACES, nd.CHUNK) for k in (0, 1)]
    signs[1, differ] ^= np.uint16(1)
    assert len(differ) <= nd.DISTANCE
    classes = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in enumerate(signs)], "node long, signature binary")
    members = nd.apart(nd.index_entries(classes).withColumn("root", F.col("node")))
    assert members.agg(F.max("size")).first()[0] == 40
    for hot in (8, 1000):
        assert [tuple(r) for r in nd._compare(members, classes, hot).collect()] == [(0, 1)]


def test_items_of_null_id_are_searched(spark, tmp_path):
    """As the operator's SQL counts them: hit and counted, but not in the list of ids."""
    passage = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(["x", *passage, "y"])), (2, " ".join(["z", *passage[:11], "q"])), (3, "x y")], "doc_id int, text string")
    bench = spark.createDataFrame([(None, " ".join(passage)), ("i1", " ".join(passage[:10]))], "item_id string, text string")
    got = rows(contamination(docs, bench), "doc_id", "n_words", "n_hit", "items")
    assert got == [(1, 14, 12, ["i1"]), (2, 13, 11, ["i1"]), (3, 2, 0, [])]
    only = bench.where("item_id is null")
    assert rows(contamination(docs, only), "doc_id", "n_hit", "items") == [(1, 12, []), (2, 11, []), (3, 0, [])]
    assert rows(drop_contaminated(docs, only), "doc_id") == [(3,)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(registry.queries()["op5_decontamination"](spark, str(tmp_path)), "doc_id", "n_items", "contaminated") == [
        (1, 2, True), (2, 2, True), (3, 0, False)]
