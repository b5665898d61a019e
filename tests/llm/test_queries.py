import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from check import TABLES, alike, normal
from clerkwise.llm import registry

from . import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    want = pd.DataFrame(result.fetchall(), columns=columns, dtype=object)
    assert sorted(frame.columns) == sorted(columns)
    assert all(alike(kind, kinds[c]) for c, kind in frame.dtypes), (frame.dtypes, kinds)
    assert normal(got) == normal(want)


def test_repeated_bytes(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    out = registry.queries()["op3_suffix_dedup"](spark, FOLDER).orderBy("doc_id")
    assert [tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()] == brute.substrings(docs, 200)


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python."""
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "pack":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()] if name != "pack" else docs.collect())
    raw = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    good, cut, single, clean, packed = kept
    bad = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
    fine = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    left = {k for k, _ in good}
    assert left <= {k for k, _ in raw} and len(fine - left) <= 0.1 * len(fine) and len(bad & left) <= 0.34 * len(bad) + 1
    assert cut == [(k, t) for k, t, n, gone in brute.lines(good) if gone < n]
    assert single == [d for d, n in zip(cut, brute.near(cut), strict=True) if n[3]]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean == [d for d, c in zip(single, brute.contamination(single, items), strict=True) if not c[2]]
    assert {r["doc_id"] for r in packed} == {k for k, _ in clean}
    assert max(r["offset"] + r["length"] for r in packed) <= 1024
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


ODD = [(None, "null id, a text of some more words than five."), (None, None), (3, ""), (3, ""), (4, "One. Two.\nThree.\nFour.\nFive."), (5, "One. Two.\nThree.\nFour.\nFive."),
       (5, "other text of this id"), (6, "long " * 60_000)]
CLASHING = "doc_id long, text string, n_lines int, N_removed string, node string, score double, held_out boolean"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, a table without n_chars, and an empty one."""
    docs = spark.createDataFrame([(i, t, 9, "own", "n", 0.5, True) for i, t in ODD], CLASHING)
    out = stage(spark, docs, FOLDER)
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    got = out.collect()
    if name == "pack":
        assert {r["doc_id"] for r in got} == {i for i, _ in ODD} and sum(r["piece"] == 0 for r in got) == len(ODD)
        return
    assert out.columns == docs.columns
    assert all(tuple(r)[2:] == (9, "own", "n", 0.5, True) for r in got)
    left = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    if name == "lines":
        assert left == sorted([d for d in ODD if d != (5, "One. Two.\nThree.\nFour.\nFive.")], key=str)
    elif name == "near_duplicates":
        assert left == sorted([d for k, d in enumerate(ODD) if k not in (3, 5)], key=str)
    elif name == "decontaminate":
        assert left == sorted(ODD, key=str)
    else:
        assert set(left) <= set(ODD)


def test_lines_keep_the_count_of_characters(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "fr", "s", 5), (2, "a\nb\nc\nd", "fr", "s", 7)], "doc_id long, text string, lang string, source string, n_chars int")
    out = dict(corpus_pipeline.STAGES)["lines"](spark, docs, FOLDER)
    assert out.schema == docs.schema and sorted(tuple(r) for r in out.collect()) == [(1, "a\nb\nc", "fr", "s", 5), (2, "d", "fr", "s", 1)]


def test_workers_need_no_package(tmp_path):
    """The package is on the driver's path only: whatever reaches a Python worker goes with the job."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(corpus_pipeline.__file__).parent)!r})
from clerkwise.session import build_session
from clerkwise.llm import registry
spark = build_session("alone", "local[4]", 4, {{"spark.checkpoint.dir": {str(tmp_path / "checkpoints")!r}}})
spark.sparkContext.setLogLevel("ERROR")
try:
    spark.range(1).mapInArrow(lambda b: __import__("clerkwise") and b, "id long").collect()
    raise SystemExit("the workers have the package")
except Exception:
    pass
for name in ("op1_language_id", "op2_toxicity", "op5_decontamination", "op8_quality", "op12_conversation_repair", "op13_hard_negatives", "pipeline"):
    print(name, registry.queries()[name](spark, {FOLDER!r}).count())
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 14
