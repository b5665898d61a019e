import io
import os
import subprocess
import sys
import time
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.operators.imports import new_documents
from clerkwise.operators.rules import literal_rules
from clerkwise.plans import registry
from clerkwise.plans.document_queries import ARCHIVES_AT_ONCE, _as_docx
from clerkwise.sources import connectors
from clerkwise.sources.files import docx_text, extract_text, read_files, write_files
from clerkwise.sources.replies import FORMAT, list_connector, register_connectors
from clerkwise.streaming.admission import admit_stream
from clerkwise.streaming.ingest import (
    LEDGER, LISTING, LISTING_PER_CORE, OPENING, SYNC_TARGETS, _append_ledger, _described, _fresh, _others, folder_stream, ingest_folder, ingest_stream, process_stream, retention_run, sla_run, sync_batch, sync_stream, synced_configs)
from clerkwise.streaming.overdue import MISSING, RUN, OverdueBuckets, OverdueProcessor, notices, overdue_stream
from tests.helpers import docs, rows, ts

AS_OF = "2024-03-10 00:00:00"


def docx(*paragraphs):
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{run}</w:t></w:r>" for run in runs) + "</w:p>" for runs in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
                         f"<w:body>{body}</w:body></w:document>")
    return data.getvalue()


def fill(folder):
    files = {"a.txt": "Grüße".encode(), "b.md": "Gr\xfc\xdfe".encode("latin-1"), "c.json": b'{"k": 1}', "d.docx": docx([" one ", "two"], [], ["three"]),
             "e.docx": b"broken", "f.pdf": b"%PDF", "g.png": b"\x89PNG", "h.csv": b"", ".hidden": b"x", "_name": b"x", "i.exe": b"x"}
    for name, data in files.items():
        (folder / name).write_bytes(data)


def test_file_text(spark, tmp_path):
    fill(tmp_path)
    files = read_files(spark, str(tmp_path)).withColumn("content_type", F.lit(None).cast("string"))
    got = {r["filename"]: (r["text"], r["method"], r["extraction_confidence"]) for r in extract_text(files).collect()}
    assert got == {
        "a.txt": ("Grüße", "native_text", 0.99), "b.md": ("Grüße", "native_text", 0.99), "c.json": ('{"k": 1}', "json_text", 0.95),
        "d.docx": ("one two\nthree", "docx_xml", 0.9), "e.docx": ("", "docx_unavailable", 0.2), "f.pdf": ("", "pdf_unavailable", 0.25),
        "g.png": ("", "ocr_placeholder", 0.2), "i.exe": ("", "ocr_placeholder", 0.2)}
    typed = files.filter("filename = 'i.exe'").withColumn("content_type", F.lit("text/x-thing"))
    assert extract_text(typed).first()["method"] == "content_type_text"
    blank = files.filter("filename = 'a.txt'").withColumn("content", F.encode(F.lit(""), "UTF-8"))
    assert extract_text(blank).first()["extraction_confidence"] == 0.1


def test_archive_readers_hold_little(spark):
    """Workers that read archives do without pandas, and archives are made a few at a time."""
    loaded = "import sys, clerkwise.plans.document_queries, clerkwise.sources.files; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", loaded], capture_output=True, text=True, check=True).stdout.strip() == "False"
    n = 2 * ARCHIVES_AT_ONCE + 3
    batch = pa.RecordBatch.from_pydict({"conv_id": [*range(n - 1), None], "turn": [1] * n, "role": ["user"] * n, "text": [f"t{i}\n<b>" for i in range(n)]})
    made = list(_as_docx([batch]))
    assert [b.num_rows for b in made] == [ARCHIVES_AT_ONCE, ARCHIVES_AT_ONCE, 3]
    assert [i for b in made for i in b["conv_id"].to_pylist()] == [*range(n - 1), None]
    assert [docx_text(c) for b in made for c in b["content"].to_pylist()] == [f"user t{i}\nuser <b>" for i in range(n)]
    files = [(1, "a.docx", docx(["x"])), (2, "b.docx", None), (3, "c.docx", b"cut"), (4, "d.txt", b"plain"), (5, "e.docm", docx(["y", " z "]))]
    got = extract_text(spark.createDataFrame(files, "k int, filename string, content binary").withColumn("content_type", F.lit(None).cast("string")), errors=True)
    assert rows(got.select("k", "text", F.col("extraction_error").isNotNull()), "k") == [
        (1, "x", False), (2, "", False), (3, "", True), (4, "plain", False), (5, "y z", False)]


def test_folder_stream_takes_each_version_once(spark, tmp_path):
    inbox, ledger, documents, checkpoint = (tmp_path / n for n in ("in", "ledger", "docs", "cp"))
    inbox.mkdir()
    fill(inbox)

    def run():
        ingest_stream(spark, str(inbox), str(ledger), str(documents), str(checkpoint), instant(AS_OF)).awaitTermination(120)
        return sorted(r["filename"] for r in spark.read.parquet(str(ledger)).collect())

    good = ["a.txt", "b.md", "c.json", "d.docx", "e.docx", "f.pdf", "g.png"]
    assert run() == good
    assert run() == good
    (inbox / "j.txt").write_text("new")
    assert run() == sorted([*good, "j.txt"])
    stored = spark.read.parquet(str(documents))
    assert stored.count() == 8 and stored.select("id").distinct().count() == 8
    assert stored.filter("status = 'ingested' and source_channel = 'watched_folder'").count() == 8
    # A new checkpoint starts its batch numbers anew; nothing that is stored may go.
    checkpoint = tmp_path / "other"
    ingest_stream(spark, str(inbox), str(ledger), str(documents), str(checkpoint), instant(AS_OF)).awaitTermination(120)
    (inbox / "k.txt").write_text("late")
    ingest_stream(spark, str(inbox), str(ledger), str(documents), str(checkpoint), instant(AS_OF)).awaitTermination(120)
    assert rows(spark.read.parquet(str(documents)).select("filename"), "filename") == [(n,) for n in sorted([*good, "j.txt", "k.txt"])]


def test_a_folder_of_folders_is_listed_by_few_tasks(spark, tmp_path):
    spark.range(120).selectExpr("id as name", "cast(id as string) as value").coalesce(1).write.partitionBy("name").text(str(tmp_path / "in"))
    group = f"listing {tmp_path}"
    spark.conf.unset(LISTING)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup(group, "listing")
    files = folder_stream(spark, str(tmp_path / "in"), recursive=True)
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= LISTING_PER_CORE * context.defaultParallelism < 120
    assert files.isStreaming


def test_folder_scan_takes_changed_files_too(spark, tmp_path):
    inbox, ledger, documents = (tmp_path / n for n in ("in", "ledger", "docs"))
    inbox.mkdir()
    fill(inbox)

    def run(batch):
        ingest_folder(spark, str(inbox), str(ledger), str(documents), batch, instant(AS_OF))
        return spark.read.parquet(str(documents)).count()

    assert run(0) == 7
    assert run(0) == 7
    assert run(1) == 7
    time.sleep(1.1)
    (inbox / "a.txt").write_text("changed")
    (inbox / "z.txt").write_text("new")
    assert run(2) == 9
    got = spark.read.parquet(str(documents)).filter("batch = 2").select("filename", F.col("content").cast("string"))
    assert rows(got, "filename") == [("a.txt", "changed"), ("z.txt", "new")]
    assert run(3) == 9


def test_processing_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "p.txt").write_text("Building permit for construction, site plan\nApplicant: John Doe\nAddress: 12 Main Street\nParcel: P-1234\nDate: 02/07/2026")
    (inbox / "q.txt").write_text("noise complaint")
    batch = read_files(spark, str(inbox)).withColumn("content_type", F.lit("text/plain")).withColumn("id", F.col("filename"))
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(inbox))
    stream = stream.withColumns({"filename": F.substring_index("path", "/", -1), "content_type": F.lit("text/plain")}).withColumn("id", F.col("filename"))
    query = (process_stream(stream, literal_rules(), instant(AS_OF)).select("id", "status", "doc_type", "confidence").writeStream.format("memory")
             .queryName("done").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    query.awaitTermination(120)
    want = rows(process_stream(batch, literal_rules(), instant(AS_OF)).select("id", "status", "doc_type", "confidence"), "id")
    assert rows(spark.table("done"), "id") == want == [("p.txt", "routed", "building_permit", 0.89), ("q.txt", "needs_review", "complaint", want[1][3])]


def test_connector_stream_keeps_a_ledger(spark, tmp_path):
    src, ledger = tmp_path / "src", tmp_path / "ledger"
    schema = "connector_type string, external_id string, filename string, content_type string, size_bytes long, metadata map<string,string>, position long"

    def put(*items):
        spark.createDataFrame([("s3", e, f, None, 5, {"k": e}, i) for i, (e, f) in enumerate(items)], schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        sync_stream(spark.readStream.schema(schema).parquet(str(src)), str(ledger), str(tmp_path / "cp"), instant(AS_OF)).awaitTermination(120)
        return sorted((r["external_id"], r["filename"]) for r in spark.read.parquet(f"{ledger}/log").collect())

    put(("a", "a1.txt"), ("a", "a2.txt"), ("b", "b.exe"))
    assert run() == [("a", "a1.txt")]
    put(("a", "a3.txt"), ("b", "b.txt"))
    assert run() == [("a", "a1.txt"), ("b", "b.txt")]


def test_a_sync_batch_that_runs_again_adds_nothing(spark, tmp_path):
    schema = "connector_type string, external_id string, filename string, content_type string, size_bytes long, metadata map<string,string>, position long"
    batch = spark.createDataFrame([("s3", e, f, None, 5, {"k": e}, i) for i, (e, f) in enumerate([("a", "a.txt"), ("a", "a2.txt"), ("b", "b.exe"), ("c", "c.md")])], schema)
    store = str(tmp_path / "store")

    def counts():
        return [spark.read.parquet(f"{store}/{t}").count() for t in SYNC_TARGETS]

    sync_batch(batch, store, "r", 0, instant(AS_OF), "w", "clerk")
    first = counts()
    sync_batch(batch, store, "r", 0, instant(AS_OF), "w", "clerk")
    assert first == counts() == [2, 2, 2, 1]
    # Broken off after the documents: the batch that runs again completes it.
    more = spark.createDataFrame([("s3", "a", "a.txt", None, 5, {}, 0), ("s3", "d", "d.txt", None, 5, {}, 1)], schema)
    new_documents(more.filter("external_id = 'd'"), ["connector_type", "external_id"], "connector", instant(AS_OF), "w").write.parquet(f"{store}/documents/run=r/batch=1")
    sync_batch(more, store, "r", 1, instant("2024-03-11 00:00:00"), "w", "clerk")
    assert counts() == [3, 3, 3, 2]
    assert {r["details"] for r in spark.read.parquet(f"{store}/audit").collect()} == {f"source=connector_s3 external_id={e}" for e in "acd"}
    assert spark.read.parquet(f"{store}/documents").filter("source_channel = 'connector_s3' and workspace_id = 'w'").count() == 3
    configs = spark.createDataFrame([("s3", "w"), ("s3", "x"), ("s3", None), ("gcs", "w")], "connector_type string, workspace_id string").withColumns(
        {c: F.lit(None).cast("timestamp") for c in ("last_sync_at", "updated_at")})
    got = {(r["connector_type"], r["workspace_id"]): r["last_sync_at"] for r in synced_configs(configs, store).collect()}
    assert got == {("s3", "w"): ts("2024-03-11 00:00:00"), ("s3", "x"): None, ("s3", None): None, ("gcs", "w"): None}
    assert synced_configs(configs, str(tmp_path / "none")).filter("last_sync_at is not null").count() == 0


def test_a_batch_reads_only_its_buckets_of_the_ledger(spark, tmp_path):
    rows_ = spark.createDataFrame([(f"h{i}",) for i in range(300)], "file_hash string")
    ledger = str(tmp_path / "ledger")
    _append_ledger(rows_.withColumns({c: F.lit("x") for c in ("filename", "source_path", "document_id")}).withColumn("created_at", instant(AS_OF)), "file_hash", ledger, "r", 0)
    known = _others(rows_.filter("file_hash in ('h1', 'h2')"), "file_hash", ledger, LEDGER, "r", 1)
    assert 2 <= known.count() < 20 and len({r["bucket"] for r in known.collect()}) <= 2
    assert {f.split("bucket=")[1].split("/")[0] for f in known.inputFiles()} == {str(r["bucket"]) for r in known.collect()}
    assert _others(rows_, "file_hash", ledger, LEDGER, "r", 0).count() == 0
    assert _others(rows_, "file_hash", str(tmp_path / "none"), LEDGER, "r", 0).count() == 0


def test_a_table_may_be_a_folder_of_files_or_one_file(spark, tmp_path):
    made = spark.createDataFrame([(i, f"text {i}", "en", "web", 40) for i in range(1, 31)], "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    made.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    logs = [rows(registry.queries()["stream_sync_log"](spark, str(tmp_path / kind)), "connector_type", "external_id") for kind in ("folder", "file")]
    assert logs[0] == logs[1] and len(logs[0]) > 10


def test_a_file_is_written_for_each_name(spark, tmp_path):
    made = spark.createDataFrame([(f"n{i}", "orc" if i % 7 == 0 else "txt", f"Grüße {i}\nx") for i in range(60)] + [("n3", "txt", "again"), ("n4", "txt", "")], "name string, kind string, value string")
    for _ in range(2):
        assert write_files(made, f"file:{tmp_path}/in") == 60
        found = {f.name: f for f in tmp_path.glob("in/*/*")}
        assert sorted(found) == sorted({f"{r['name']}.{r['kind']}" for r in made.collect()})
        assert sorted(found["n3.txt"].read_text().splitlines()) == ["Grüße 3", "again", "x"] and found["n1.txt"].read_text() == "Grüße 1\nx\n"
        assert spark.read.orc(str(found["n7.orc"])).count() == 1
    assert len({f.parent for f in found.values()}) > 30
    assert write_files(made.limit(0), str(tmp_path / "none")) == 0


def test_contents_are_not_shuffled_to_a_small_ledger(spark, tmp_path):
    inbox, ledger = tmp_path / "in", str(tmp_path / "ledger")
    inbox.mkdir()
    for i in range(5):
        (inbox / f"{i}.txt").write_text(f"text {i}")
    files = _described(read_files(spark, str(inbox)))
    seen = files.filter("filename < '2'").select("file_hash", "filename", F.col("path").alias("source_path"), F.lit("x").alias("document_id"), instant(AS_OF).alias("created_at"))
    _append_ledger(seen, "file_hash", ledger, "r", 0)
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    fresh = _fresh(_described(read_files(own, str(inbox))), ledger, "r", 1)
    assert sorted(r["filename"] for r in fresh.collect()) == ["2.txt", "3.txt", "4.txt"]
    assert "SortMergeJoin" not in fresh._jdf.queryExecution().executedPlan().toString()


def test_small_files_share_tasks_and_a_ledger_has_several_writers(spark, tmp_path):
    own = spark.newSession()
    for i in range(200):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    folder_stream(own, str(tmp_path))
    assert own.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions() <= own.sparkContext.defaultParallelism
    own.conf.set(OPENING, "1m")
    folder_stream(own, str(tmp_path))
    assert own.conf.get(OPENING) == "1m"
    entries = spark.range(40).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("file_hash"), *[F.lit("x").alias(c) for c in ("filename", "source_path", "document_id")],
                                     instant(AS_OF).alias("created_at"))
    _append_ledger(entries, "file_hash", str(tmp_path / "ledger"), "r", 0)
    assert len({f.name.split("-")[1] for f in (tmp_path / "ledger").rglob("*.parquet")}) > 1


def test_overdue_timers_go_on_after_a_restart(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    schema = "id string, workspace_id string, filename string, status string, due_date timestamp, assigned_to string, at timestamp"

    def put(*changes):
        spark.createDataFrame([(i, "w", f"{i}.txt", status, ts(due) if due else None, user, ts(at)) for i, status, due, user, at in changes], schema).coalesce(1).write.mode("append").parquet(str(src))
        changed = spark.readStream.schema(schema).parquet(str(src)).withWatermark("at", "0 seconds")
        (overdue_stream(changed, "at", "boss", days=5).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination(180))
        return sorted((r["document_id"], r["kind"], r["at"].day, r["days_overdue"], r["user_id"]) for r in spark.read.parquet(str(out)).collect())

    first = put(("a", "routed", "2024-01-01 00:00:00", "u", "2023-12-20 00:00:00"), ("b", "routed", "2024-01-02 00:00:00", None, "2023-12-21 00:00:00"),
                ("c", "approved", "2024-01-01 00:00:00", None, "2023-12-21 00:00:00"), ("d", "routed", None, None, "2023-12-22 00:00:00"),
                ("clock", "approved", None, None, "2024-01-02 12:00:00"))
    assert first == [("a", "overdue", 1, 0, "u"), ("a", "overdue", 2, 1, "u"), ("b", "overdue", 2, 0, None)]
    # b is closed; a goes on where it stood, is escalated on the third day and forgotten after the fifth.
    second = put(("b", "completed", "2024-01-02 00:00:00", None, "2024-01-02 13:00:00"), ("clock", "approved", None, None, "2024-01-20 00:00:00"))
    assert [x for x in second if x not in first] == [("a", "escalated", 4, 3, "boss"), ("a", "overdue", 3, 2, "u"), ("a", "overdue", 4, 3, "u"), ("a", "overdue", 5, 4, "boss")]


def test_an_overdue_document_takes_few_calls_to_the_state():
    calls, now = [], 1_000_000_000

    class Store:
        held = ("w", "f", "u", now + 5, now + 5, 1)

        def __getattr__(self, name):
            def call(*given):
                calls.append((name, *given))
                return {"get": self.held, "getValueState": self, "getCurrentWatermarkInMs": now}.get(name)
            return call

    processor = OverdueProcessor("boss", 3, 86_400_000, None)
    processor.init(Store())
    calls.clear()
    change = Row(workspace_id="w", filename="f", assigned_to=None, open=True, due=now + 9, seen=2)
    assert list(processor.handleInputRows(("d",), iter([change, Row(**change.asDict() | {"due": 3, "seen": 1})]), Store())) == []
    assert [c[0] for c in calls] == ["get", "deleteTimer", "getCurrentWatermarkInMs", "update", "registerTimer"]
    assert calls[1][1] == now + 5 and calls[-1][1] == now + 9


class Kept:
    """The state of one key, its timers and the clock."""

    def __init__(self, now):
        self.held, self.timers, self.now, self.calls = None, set(), now, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.held, self.calls = value, self.calls + 1

    def clear(self):
        self.held = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_bucket_of_documents_takes_as_many_calls_as_one():
    day, columns = 86_400_000, ["key", "workspace_id", "filename", "assigned_to", "open", "due", "seen"]
    kept = Kept(0)
    processor = OverdueBuckets(OverdueProcessor("boss", 3, day, 5))
    processor.init(kept)

    def batch(now, *rows_):
        kept.now, out = now, []
        if rows_:
            out += [tuple(r) for f in processor.handleInputRows((1,), iter([pd.DataFrame(rows_[:2], columns=columns), pd.DataFrame(rows_[2:], columns=columns)]), kept) for r in f.itertuples(index=False)]
        for at in sorted(t for t in kept.timers if t < now):
            out += [tuple(r) for f in processor.handleExpiredTimer((1,), kept, None) for r in f.itertuples(index=False)]
            kept.timers.remove(at)
        return sorted((r[0] or "", *r[4:]) for r in out)

    # The second row of d0 is older; d9 is closed, d8 has no due date, and one document has no id.
    first = [("d0", "w", "f", "u", True, 5 * day, 2), ("d0", "w", "f", None, True, day, 1), ("d9", "w", "f", None, False, day, 1), ("d8", "w", "f", None, True, MISSING, 1), (None, "w", None, None, True, 3 * day, MISSING)]
    assert batch(0, *first, *[(f"e{i}", "w", "f", "u", True, 100 * day, 1) for i in range(50)]) == []
    assert kept.calls == 2 and kept.timers == {3 * day}
    assert batch(3 * day) == [] and kept.timers == {3 * day}
    assert batch(3 * day + 1) == [("", 3 * day, 3 * day, 1)] and kept.timers == {4 * day}
    assert batch(6 * day, ("d0", "w", "f", None, False, 5 * day, 3)) == [("", 3 * day, 4 * day, 2)] and kept.timers == {6 * day}
    # A change keeps the time of the next notice, and what is due after five days is forgotten.
    assert batch(50 * day, (None, "w", None, "v", True, 2 * day, 9)) == [("", 2 * day, 6 * day, 1)] and kept.timers == {100 * day}
    assert batch(50 * day, *[(f"e{i}", "w", "f", "u", False, 100 * day, 2) for i in range(50)]) == []
    assert kept.held is None and kept.timers == set()


def test_runs_of_notices_equal_a_plain_loop(spark):
    day = 86_400_000
    made = [(f"{i}", "w", ("", None, "f")[i % 3], (None, "u", "boss", "\u2003")[i % 4], 7 * day, 7 * day + i % 5 * (day // 2), i % 9 + 1) for i in range(60)]
    for fallback, after, every in (("boss", 2, day), ("boss", 1, day // 2), ("", 1, day), ("boss", 0, day)):
        want = []
        for name, w, filename, user, due, at, n in made:
            for _ in range(n):
                late, shown = (at - due) // day, filename or "Document"
                want.append((name, "overdue", at, late, user, w, f"Overdue: {shown}", f"{late}d overdue"))
                if fallback and late >= after and user != fallback:
                    former = user if (user or "").strip() else "unassigned"
                    want.append((name, "escalated", at, late, fallback, w, f"Escalated: {shown}", f"Reassigned from {former} to {fallback} ({late}d overdue)"))
                    user = fallback
                at += every
        got = notices(spark.createDataFrame(made, RUN), fallback, after, every).withColumn("at", F.unix_millis("at"))
        assert sorted(rows(got), key=str) == sorted(want, key=str)


def test_silent_keys_are_forgotten(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("a", ts("2024-01-01 00:00:00"), 1), ("a", ts("2024-01-01 00:00:01"), 2), ("a", ts("2024-01-01 00:00:02"), 3)], "k string, at timestamp, n long").write.parquet(str(src))

    def run():
        stream = spark.readStream.schema("k string, at timestamp, n long").parquet(str(src))
        query = (admit_stream(stream, "k", "at", "n", 2, 60, 3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start())
        query.awaitTermination(120)
        return rows(spark.read.parquet(str(tmp_path / "out")).select("id", "allowed"), "id")

    assert run() == [(1, True), (2, True), (3, False)]
    time.sleep(4)
    spark.createDataFrame([("a", ts("2024-01-01 00:00:03"), 4)], "k string, at timestamp, n long").write.mode("append").parquet(str(src))
    # The state of the key is gone with its three seconds of silence, so that it starts anew.
    assert run() == [(1, True), (2, True), (3, False), (4, True)]


def test_replies_as_a_source(spark, tmp_path):
    register_connectors(spark)
    for fetched, ids in ((1, "ab"), (2, "c"), (3, "de")):
        folder = tmp_path / "connector_type=jira" / f"fetched={fetched}"
        folder.mkdir(parents=True)
        for page, i in enumerate(ids):
            (folder / f"page{page}.json").write_text('{"issues": [{"key": "K", "fields": {"attachment": [{"id": "%s"}]}}]}\n' % i)
        (folder / "_SUCCESS").write_text("")
    replies = spark.read.format(FORMAT).option("path", str(tmp_path)).option("connector", "jira").load()
    assert replies.rdd.getNumPartitions() == 5
    later = replies.filter("fetched > 1 and page <> 'x'")
    assert later.rdd.getNumPartitions() == 3 and sorted(r["fetched"] for r in later.collect()) == [2, 3, 3]
    assert sorted(r["external_id"] for r in list_connector(spark, "jira", str(tmp_path), since=2).collect()) == ["jira_d", "jira_e"]
    assert list_connector(spark, "sharepoint", str(tmp_path), site_url="https://s").count() == 0
    for wrong, options in (("fax", {}), ("jira", {"site_url": "x"})):
        with pytest.raises(ValueError):
            list_connector(spark, wrong, str(tmp_path), **options)

    def drained():
        stream = spark.readStream.format(FORMAT).option("path", str(tmp_path)).option("connector", "jira").option("since", "1").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["fetched"] for r in spark.read.schema("fetched long").parquet(str(tmp_path / "out")).collect())

    assert drained() == [2, 3, 3] == drained()
    folder = tmp_path / "connector_type=jira" / "fetched=7"
    folder.mkdir()
    (folder / "p.json").write_text("{}")
    assert drained() == [2, 3, 3, 7]


def test_admission_stream(spark, tmp_path):
    src = tmp_path / "src"
    base = ts("2024-01-01 00:00:00").timestamp()

    def put(*items):
        df = spark.createDataFrame([(k, float(base + s), i) for k, s, i in items], "k string, s double, n long")
        df.select("k", F.timestamp_seconds("s").alias("at"), "n").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)

    put(("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 0, 3))
    put(("a", 60, 4), ("a", 60.5, 5), ("b", 30, 6), ("b", 31, 7))
    stream = spark.readStream.schema("k string, at timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(src))
    query = (admit_stream(stream, "k", "at", "n", 2, 60).writeStream.format("memory").queryName("admitted").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(180)
    assert rows(spark.table("admitted").select("id", "allowed"), "id") == [
        (0, True), (1, True), (2, False), (3, True), (4, False), (5, True), (6, True), (7, False)]


def test_scheduled_runs(spark):
    snapshot = docs(spark, {"due_date": ts("2024-03-01 00:00:00")})
    none = spark.createDataFrame([], "document_id string, type string, created_at timestamp")
    assert sla_run(snapshot, none, instant(AS_OF)).first()["title"] == "Overdue: f.txt"
    log = spark.createDataFrame([(1, ts("2010-01-01 00:00:00")), (2, ts("2024-01-01 00:00:00"))], "id int, created_at timestamp")
    kept = retention_run({"audit_events": log, "notifications": log}, instant(AS_OF))
    assert [kept[n].count() for n in ("audit_events", "notifications")] == [1, 1]


def test_listing_edges(spark):
    def payload(text):
        return spark.createDataFrame([(text,)], "payload string")

    sn = payload('{"result": [{"sys_id": "", "attachments": [{"sys_id": "x"}]}, {"sys_id": "r", "number": "N", "attachments": [{"sys_id": "0123456789", "size_bytes": "0"}]}]}')
    got = connectors.list_external("servicenow", sn, base_url="https://x").collect()
    assert [(g["external_id"], g["filename"], g["size_bytes"]) for g in got] == [("sn_0123456789", "attachment_01234567", None)]
    jira = payload('{"issues": [{"key": "K", "fields": {"attachment": null}}, {"key": "L", "fields": {"summary": "s", "attachment": [{"id": "1"}]}}]}')
    assert [(g["external_id"], g["filename"]) for g in connectors.list_external("jira", jira).collect()] == [("jira_1", "attachment")]
    sf = connectors.salesforce(payload('{"records": [{"Id": "1", "CreatedDate": "2024-01-01"}, {"Id": "2", "CreatedDate": "2024-02-01"}]}'), "https://i")
    assert [g["external_id"] for g in connectors.newest_first(sf, 1).collect()] == ["sf_2"]
    assert "access_token" not in sf.first()["metadata"]
    sp = connectors.sharepoint(payload('{"d": {"results": [{"Id": 5, "FileLeafRef": "a.txt", "FileRef": "/a.txt", "File": {"Length": "x"}}, {"Id": 6, "FileLeafRef": "b"}]}}'), "https://s")
    assert [(g["external_id"], g["size_bytes"], g["content_type"]) for g in sp.collect()] == [("sp_5_a.txt", None, "text/plain")]
    objects = spark.createDataFrame([("in/a.txt", "0"), ("in/", "0"), ("out/b.txt", "5")], "key string, size string").withColumn("content_type", F.lit("x/y"))
    got = connectors.object_store(objects, "gcs", "b", "https://g", "in/").collect()
    assert [(g["external_id"], g["filename"], g["content_type"], g["size_bytes"]) for g in got] == [("gcs_b_in/a.txt", "a.txt", "x/y", None)]
    try:
        connectors.list_external("fax", sn)
        raise AssertionError
    except ValueError as error:
        assert "Unknown connector type: fax" in str(error)
    assert os.sep == "/"


def test_download_addresses(spark):
    keys = spark.createDataFrame([("in/a b#1.txt", 5)], "key string, size long")
    urls = [connectors.object_store(keys, kind, "b", "https://h").first()["download_url"] for kind in ("s3", "gcs")]
    assert urls == ["https://h/in/a%20b%231.txt", "https://h/storage/v1/b/b/o/in%2Fa%20b%231.txt?alt=media"]
