import sqlite3

import pytest
from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.operators import changes, imports, joins
from clerkwise.session import broadcast_if_small, is_small, number_rows, spread
from clerkwise.sources import snapshots
from clerkwise.sources.database import read_database
from clerkwise.sources.tables import copy_tables
from tests.helpers import column, docs, rows, ts


def test_upload_reasons_in_order(spark):
    df = spark.createDataFrame([
        (" ", "text/plain", 0), ("a.txt", "text/plain", 0), ("a.txt", "text/plain", 26214401), ("a.exe", "text/plain", 1), ("a", "text/plain", 1),
        ("a.txt", "video/mp4", 1), ("a.txt", None, 1), ("A.PDF", " Application/PDF", 26214400), (".txt", "text/plain", 1),
    ], "filename string, content_type string, length long")
    got = [r["reject_reason"] for r in imports.validate_files(df).collect()]
    assert got[0] == "File name is required." and got[1] == "Uploaded file is empty."
    assert got[2].startswith("File too large") and got[3].startswith("File extension") and got[4].startswith("File extension")
    assert got[5] == got[6] == "Unsupported content type."
    assert got[7] is None and got[8].startswith("File extension")


def test_outcomes_equal_a_row_loop(spark):
    listing = [("s3", "a", 0, "a.exe"), ("s3", "a", 1, "a.txt"), ("s3", "a", 2, "a.txt"), ("s3", "b", 3, "b.txt"), ("jira", "a", 4, "c.txt"),
               ("s3", "c", 5, "c.exe"), ("s3", "c", 6, "c.exe"), ("s3", "a", 7, "a.exe")]
    seen, want = {("s3", "b")}, []
    for kind, ext, _, name in listing:
        if (kind, ext) in seen:
            want.append("skipped")
        elif name.endswith(".exe"):
            want.append("failed")
        else:
            seen.add((kind, ext))
            want.append("imported")
    df = spark.createDataFrame([(k, e, p, n, "text/plain", 5) for k, e, p, n in listing],
                               "connector_type string, external_id string, position long, filename string, content_type string, length long")
    ledger = spark.createDataFrame([("s3", "b")], "connector_type string, external_id string")
    out = imports.import_outcomes(df, ledger, ["connector_type", "external_id"], ["position"])
    assert [r["outcome"] for r in out.orderBy("position").collect()] == want
    assert tuple(imports.import_summary(out).first()) == (want.count("imported"), want.count("skipped"), want.count("failed"))
    assert imports.import_errors(out, ["position"], 50).first()["error"].startswith("a.exe: Validation failed — File extension")
    fresh = imports.new_only(df, ledger, ["connector_type", "external_id"], ["position"])
    assert sorted(r["position"] for r in fresh.collect()) == [0, 4, 5]


def test_rows_of_a_database(spark, tmp_path):
    path = tmp_path / "in.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE docs (id INTEGER, FileName TEXT, Content BLOB)")
        db.executemany("INSERT INTO docs VALUES (?, ?, ?)", [(i, f"dir/f{i}.txt" if i % 3 else None, b"x" * i) for i in range(1, 21)])
    df = read_database(spark, f"sqlite:///{path}", "SELECT id, FileName, Content FROM docs", partitionColumn="id", lowerBound="1", upperBound="21", numPartitions="4")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 20
    got = {r["position"]: r for r in imports.import_rows(df, "id", "filename", "content", None).collect()}
    assert got[3]["filename"] == "db_document_3.txt" and got[4]["filename"] == "f4.txt"
    assert got[4]["outcome"] == "imported" and bytes(got[4]["content"]) == b"xxxx"
    missing = imports.import_rows(df, "id", "filename", "nope", None).first()
    assert missing["outcome"] == "failed" and missing["error"].endswith("Missing expected column 'nope'.")
    limited = imports.import_rows(df, "id", "filename", "content", None, limit=5)
    assert sorted(r["position"] for r in limited.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        read_database(spark, f"sqlite:///{path}", "DELETE FROM docs")
    with pytest.raises(ValueError):
        read_database(spark, "oracle://x/y", "SELECT 1")
    with pytest.raises(ValueError):
        read_database(spark, "sqlite:///:memory:", "SELECT 1")


def test_path_wins_over_content(spark):
    table = spark.createDataFrame([(1, "a.txt", "own", "/in/a"), (2, "b.txt", "own", None), (3, "c.txt", "own", "/in/none")],
                                  "id long, filename string, content string, path string")
    files = spark.createDataFrame([("/in/a", bytearray(b"file"))], "path string, content binary")
    got = imports.import_rows(table, "id", content_type_column=None, file_path_column="path", files=files).orderBy("position").collect()
    assert [bytes(g["content"]) if g["content"] else None for g in got] == [b"file", b"own", None]
    assert got[2]["error"] == "Row 3: Path not found: /in/none"


def test_readonly_guard(spark):
    queries = ["select 1", "SELECT a -- drop\nfrom t", "/* x */ with a as (select 1) select * from a;", "select 1; select 2", "", None, "-- x", "drop table t",
               "select * from t where replace = 1", "select updated from t"]
    got = column(spark, queries, imports.guard_readonly)
    assert got[:3] == [None, None, None] and got[3] == "Only one SELECT statement is allowed."
    assert got[4] == got[5] == "Query is required." and got[6].startswith("Query is empty") and got[7].startswith("Only SELECT")
    assert got[8] == "Query contains a disallowed keyword: 'replace'." and got[9] is None
    for query, reason in zip(queries, got):
        if reason is None:
            assert imports.check_query(spark, query) == query.strip()
        else:
            with pytest.raises(ValueError):
                imports.check_query(spark, query)


def test_merge_upsert_insert_delete(spark):
    base = docs(spark, {}, {}, {}).select("id", "status", "updated_at")
    change = spark.createDataFrame([("d1", "routed"), ("zz", "routed")], "id string, status string")
    now = instant("2024-06-01 00:00:00")
    assert rows(changes.update_by_key(base, change, "id", ["status"], now).select("id", "status", "updated_at"), "id") == [
        ("d0", "needs_review", ts("2024-01-02 00:00:00")), ("d1", "routed", ts("2024-06-01 00:00:00")), ("d2", "needs_review", ts("2024-01-02 00:00:00"))]
    partial = spark.createDataFrame([("d1", None)], "id string, status string")
    assert rows(changes.update_present(base, partial, "id", ["status"]), "id")[1][1] == "needs_review"
    members = spark.createDataFrame([("w", "u", "member", 1), ("w", "v", "admin", 1)], "ws string, user string, role string, joined int")
    new = spark.createDataFrame([("w", "u", "admin", 5), ("w", "u", "owner", 6), ("w", "x", "member", 7)], "ws string, user string, role string, joined int")
    assert rows(changes.upsert(members, new, ["ws", "user"], ["joined"], keep=["joined"]), "user") == [
        ("w", "u", "owner", 1), ("w", "v", "admin", 1), ("w", "x", "member", 7)]
    assert rows(changes.insert_ignore(members, new, ["ws", "user"], ["joined"]), "user") == [
        ("w", "u", "member", 1), ("w", "v", "admin", 1), ("w", "x", "member", 7)]
    assert rows(changes.delete_keys(members, new, ["ws", "user"]), "user") == [("w", "v", "admin", 1)]


def test_rank_limits_reach_the_map_side(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = changes.last_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_retention(spark):
    log = spark.createDataFrame([(1, ts("2020-01-01 00:00:00")), (2, ts("2024-01-01 00:00:00")), (3, None)], "id int, created_at timestamp")
    cutoff = changes.retention_cutoff("notifications", instant("2024-06-01 00:00:00"))
    assert sorted(r["id"] for r in changes.purge_before(log, "created_at", cutoff).collect()) == [2, 3]
    assert tuple(changes.purge_count(log, "created_at", cutoff).first()) == (1, 2)


def test_bootstrap_only_without_workspaces(spark):
    users = spark.createDataFrame([("a", "member", ts("2020-01-01 00:00:00")), ("b", " Admin ", ts("2021-01-01 00:00:00")), ("c", "admin", ts("2022-01-01 00:00:00"))],
                                  "id string, role string, created_at timestamp")
    none = spark.createDataFrame([], "id string")
    space, members = changes.bootstrap_workspace(users, none, "w0", instant("2024-01-01 00:00:00"))
    assert space.first()["owner_id"] == "b"
    assert rows(members.select("user_id", "role"), "user_id") == [("a", "member"), ("b", "admin"), ("c", "member")]
    some = spark.createDataFrame([("w",)], "id string")
    assert changes.bootstrap_workspace(users, some, "w0", instant("2024-01-01 00:00:00"))[1].count() == 0


def test_numbering_is_exact_under_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
                                  (F.col("id") * 7919 % 3001).alias("o"))
    got = number_rows(df, ["o"], "n", ["k"]).collect()
    want, counter = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        counter[r["k"]] = counter.get(r["k"], 0) + 1
        want[r["k"], r["o"]] = counter[r["k"]]
    assert {(r["k"], r["o"]): r["n"] for r in got} == want
    overall = number_rows(df, ["o"], "n").collect()
    assert [r["n"] for r in sorted(overall, key=lambda r: r["o"])] == list(range(1, 3001))


def test_slugs(spark):
    df = spark.createDataFrame([("Town Hall", 1), ("town-hall!", 2), ("Park", 3), ("Town  hall", 4)], "name string, at int")
    from clerkwise.functions.text import slug_base

    out = joins.unique_slugs(df, ["at"], slug_base(F.col("name")))
    assert [r["slug"] for r in out.orderBy("at").collect()] == ["town-hall", "town-hall-2", "park", "town-hall-3"]
    spelled = spark.createDataFrame([("A-2", 1), ("A", 2), ("A", 3), ("a 2", 4), ("A-2-2", 5), ("a", 6), ("A-4", 7)], "name string, at int")
    got = joins.unique_slugs(spelled, ["at"], slug_base(F.col("name"))).orderBy("at").collect()
    assert [r["slug"] for r in got] == ["a-2", "a", "a-3", "a-2-3", "a-2-2", "a-5", "a-4"]


def test_size_checks(spark):
    df = spark.range(100)
    assert is_small(df, 100) and not is_small(df, 99)
    plan = broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan.lower()
    assert "broadcast" not in broadcast_if_small(df, max_rows=10)._jdf.queryExecution().analyzed().toString().lower()
    one_split = spark.range(10, numPartitions=1)
    assert spread(one_split).rdd.getNumPartitions() == 4
    assert spread(spark.range(10, numPartitions=3)).rdd.getNumPartitions() == 3


def test_table_copy(spark, tmp_path):
    tables = {"users": spark.range(7).withColumnRenamed("id", "k"), "documents": spark.range(3)}
    counts = copy_tables(tables, str(tmp_path))
    assert rows(counts) == [("documents", 3, 3), ("users", 7, 7)]
    again = copy_tables({"documents": spark.range(2)}, str(tmp_path), truncate=False)
    assert rows(again) == [("documents", 2, 5)]


def test_null_keys_are_keys(spark):
    base = spark.createDataFrame([(None, "old"), ("a", "old")], "k string, v string")
    new = spark.createDataFrame([(None, "new", 1), (None, "newer", 2), ("b", "new", 3)], "k string, v string, n int")
    assert changes.new_rows(base, new, ["k"], ["n"]).select("k").collect() == [("b",)]
    got = changes.upsert(base, new, ["k"], ["n"])
    assert sorted((str(r["k"]), r["v"]) for r in got.collect()) == [("None", "newer"), ("a", "old"), ("b", "new")]
    assert changes.delete_keys(base, new, ["k"]).collect() == [("a", "old")]


def test_content_as_text(spark):
    from pyspark.sql import types as T

    numbers = [1.0, -2.5, 1e16, 1.5e16, 123456789.25, 1e-4, 1.5e-5, 1e22, 1e300, -1e-300, 0.0, float("inf"), float("nan")]
    got = column(spark, numbers, lambda c: imports.coerce_content(c, T.DoubleType()).cast("string"), "double")
    assert got == [str(n) for n in numbers]
    made = spark.createDataFrame([(1, None, [1, 2], {"k": True}, "é\"")], "a int, b string, c array<int>, d map<string,boolean>, e string")
    whole = made.select(F.struct("*").alias("x"))
    got = whole.select(imports.coerce_content(F.col("x"), whole.schema["x"].dataType).cast("string")).first()[0]
    assert got == '{"a": 1, "b": null, "c": [1, 2], "d": {"k": true}, "e": "é\\""}'
    assert imports.unsupported_content(T.TimestampType()) and not imports.unsupported_content(T.LongType())


def test_content_of_a_type_without_text(spark):
    table = spark.createDataFrame([(1, "a.txt", ts("2024-01-01 00:00:00")), (2, "b.txt", None)], "id long, filename string, content timestamp")
    got = imports.import_rows(table, "id").orderBy("position").collect()
    assert [r["error"] for r in got] == ["Row 1: Unsupported content type: timestamp", "Row 2: Content value is empty."]


def test_snapshots_rewrite_only_the_buckets_of_a_change(spark, tmp_path):
    path = str(tmp_path / "snap")
    base = spark.range(500).selectExpr("id", "'old' AS state", "map('k', id) AS more").unionByName(spark.sql("SELECT cast(null AS bigint) AS id, 'old' AS state, cast(null AS map<string,bigint>) AS more"))
    snapshots.write_snapshot(base, path, "id", 16)
    change = spark.createDataFrame([(3, "new"), (900, "new")], "id long, state string")
    wrote = snapshots.change_snapshot(spark, path, change, lambda rows_, new: changes.update_by_key(rows_, new, "id", ["state"]))
    assert 1 <= wrote.count() <= 2 and {r["held"] for r in wrote.collect()} == {2}
    touched = {r["bucket"] for r in wrote.collect()}
    files = snapshots.read_snapshot(spark, path).inputFiles()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files if "version=2" in f} == touched
    assert sum("version=1" in f for f in files) >= 14
    state = {r["id"]: r["state"] for r in snapshots.read_snapshot(spark, path).collect()}
    assert len(state) == 501 and state[3] == "new" and state[None] == "old" and 900 not in state
    gone = spark.range(500).select("id")
    snapshots.change_snapshot(spark, path, gone, lambda rows_, some: changes.delete_keys(rows_, some, ["id"]))
    assert [r["id"] for r in snapshots.read_snapshot(spark, path).collect()] == [None]
    assert snapshots.read_snapshot(spark, path, 1).count() == 501 and snapshots.read_snapshot(spark, path, 2).filter("state = 'new'").count() == 1
    snapshots.write_snapshot(base.limit(3), path, "id", 8)
    assert snapshots.read_snapshot(spark, path).count() == 3
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, str(tmp_path / "none"))


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    name = tmp_path.name.replace("-", "_")
    a = snapshots.bucketed_table(spark.range(300).selectExpr("id", "id * 2 AS x"), f"a_{name}", str(tmp_path / "a"), "id", 4)
    b = snapshots.bucketed_table(spark.range(100, 400).selectExpr("id", "id * 3 AS y"), f"b_{name}", str(tmp_path / "b"), "id", 4)
    joined = a.hint("merge").join(b, "id")
    assert joined.count() == 200 and "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_sqlite_columns_take_the_widest_type(spark, tmp_path):
    path = tmp_path / "t.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id, n, mixed, blob, empty_one)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(1, 1, 1, b"x", None), (2, 2.75, "two", None, None), (3, None, 2.5, b"y", None)])
    df = read_database(spark, f"sqlite:///{path}", "SELECT * FROM t")
    assert [k for _, k in df.dtypes] == ["bigint", "double", "string", "binary", "string"]
    assert rows(df.select("id", "n", "mixed"), "id") == [(1, 1.0, "1"), (2, 2.75, "two"), (3, None, "2.5")]
