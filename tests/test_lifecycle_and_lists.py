import random

from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.functions.predicates import TRANSITIONS, visible_to
from clerkwise.operators import analytics, joins, lifecycle, listing
from clerkwise.operators.rules import literal_rules
from tests.helpers import docs, rows, ts

def now():
    return instant("2024-03-10 00:00:00")



def test_every_edge(spark):
    statuses = [*TRANSITIONS, "archived", "odd"]
    snapshot = docs(spark, *[{"status": s} for s in statuses])
    pairs = [(f"d{i}", t, None) for i in range(len(statuses)) for t in statuses]
    requests = spark.createDataFrame(pairs + [("zz", "approved", None)], "document_id string, to_status string, notes string")
    got = lifecycle.apply_transitions(snapshot, requests).collect()
    for r in got:
        if r["document_id"] == "zz":
            assert r["error"] == "not found" and not r["applied"]
        else:
            assert r["applied"] == (r["to_status"] in TRANSITIONS.get(r["from_status"], []))
    log = lifecycle.transition_audit(lifecycle.apply_transitions(snapshot, requests), "a", now())
    assert log.count() == sum(map(len, TRANSITIONS.values()))


def test_assign_and_auto_assign(spark):
    snapshot = docs(spark, {"status": "needs_review", "due_date": None}, {"status": "acknowledged", "due_date": ts("2024-05-01 00:00:00"), "assigned_to": " "},
                    {"status": "needs_review", "due_date": ts("2024-04-01 00:00:00"), "assigned_to": "u"}, {"status": "routed"})
    requests = spark.createDataFrame([("d0", "u1"), ("d3", "u1"), ("no", "u1")], "document_id string, user_id string")
    assert rows(lifecycle.assign(snapshot, requests).select("document_id", "status"), "document_id") == [("d0", "assigned"), ("d3", "routed")]
    assert [r["document_id"] for r in lifecycle.auto_assign(snapshot, limit=1).collect()] == ["d1"]
    assert tuple(lifecycle.auto_assign_counts(snapshot, 1).first()) == (1, 1)


def test_review(spark):
    snapshot = docs(spark, *[{"doc_type": "complaint", "extracted_fields": {"a": "1", "b": "2"}, "missing_fields": ["x"], "status": "archived"}] * 4)
    reviews = spark.createDataFrame([
        ("d0", False, "no", None, None, None), ("d1", True, None, None, None, None), ("d2", True, None, "court_filing", "Desk", {"b": "3"}), ("d3", True, None, None, None, {}),
    ], "document_id string, approve boolean, notes string, corrected_doc_type string, corrected_department string, corrected_fields map<string,string>")
    got = {r["document_id"]: r for r in lifecycle.review(snapshot, reviews, literal_rules()).collect()}
    assert (got["d0"]["status"], got["d0"]["requires_review"], got["d0"]["missing_fields"]) == ("needs_review", True, ["x"])
    assert (got["d1"]["status"], got["d1"]["department"], got["d1"]["missing_fields"]) == ("approved", "Code Enforcement", [])
    assert (got["d2"]["status"], got["d2"]["department"], got["d2"]["extracted_fields"]) == ("corrected", "Desk", {"a": "1", "b": "3"})
    assert got["d3"]["status"] == "approved"


def test_bulk(spark):
    snapshot = docs(spark, {"status": "archived"}, {"status": "needs_review"}, {"status": "routed"})
    requests = spark.createDataFrame([
        ("d0", "approve", None, None), ("d1", "assign", "u", None), ("d1", "assign", None, None), ("d2", "transition", None, "archived"),
        ("d2", "transition", None, "approved"), ("d2", "transition", None, None), ("d2", "shred", None, None), ("zz", "approve", None, None),
    ], "document_id string, action string, user_id string, to_status string")
    got = lifecycle.bulk(snapshot, requests)
    assert tuple(lifecycle.bulk_counts(got).first()) == (3, 5)
    errors = sorted(r["error"] for r in got.collect() if r["error"])
    assert errors == ["d1: user_id required for assign", "d2: invalid transition routed → archived", "d2: status required for transition",
                      "d2: unknown action 'shred'", "zz: not found"]


def test_read_marks_and_retries(spark):
    notes = spark.createDataFrame([(1, "a", False), (2, None, False), (3, "b", False), (4, "a", True)], "id int, user_id string, is_read boolean").withColumn(
        "read_at", F.lit(None).cast("timestamp"))
    got = lifecycle.mark_read(notes, visible_to("a"), now())
    assert sorted(r["id"] for r in got.collect() if r["changed"]) == [1, 2]
    ids = spark.createDataFrame([(3,), (4,)], "id int")
    assert sorted(r["id"] for r in lifecycle.mark_read(notes, visible_to("a"), now(), ids).collect() if r["changed"]) == [4]
    jobs = spark.createDataFrame([(1, 2, 3), (2, 3, 3)], "id int, attempts int, max_attempts int").withColumns(
        {"started_at": now(), "finished_at": F.lit(None).cast("timestamp"), "status": F.lit("failed")})
    got = {r["id"]: r for r in lifecycle.retry_jobs(jobs, now()).collect()}
    assert (got[1]["status"], got[1]["started_at"], got[1]["finished_at"]) == ("queued", None, None)
    assert (got[2]["status"], got[2]["finished_at"]) == ("failed", ts("2024-03-10 00:00:00"))


def test_overdue_is_strict_and_knows_done(spark):
    snapshot = docs(spark, {"due_date": ts("2024-03-10 00:00:00")}, {"due_date": ts("2024-03-09 23:59:59")}, {"due_date": ts("2024-03-01 00:00:00"), "status": "archived"},
                    {"due_date": ts("2024-03-01 00:00:00"), "status": "failed"}, {})
    assert [r["id"] for r in listing.overdue(snapshot, now(), 10).collect()] == ["d3", "d1"]
    assert analytics.overdue_count(snapshot, now()).first()["total"] == 2


def test_orders(spark):
    snapshot = docs(spark, {"urgency": "high", "updated_at": ts("2024-01-01 00:00:00")}, {"due_date": ts("2024-01-01 00:00:00")}, {"requires_review": True},
                    {"updated_at": ts("2024-02-01 00:00:00")}, {"updated_at": None})
    assert [r["id"] for r in listing.priority_order(snapshot, now()).collect()] == ["d0", "d1", "d2", "d3", "d4"]
    statuses = docs(spark, {"status": "acknowledged"}, {"status": "assigned"}, {"status": "needs_review"}, {"status": "failed"}, {"status": "needs_review"})
    assert [r["id"] for r in listing.sweep_candidates(statuses, 3).collect()] == ["d2", "d4", "d1"]
    assert [r["id"] for r in listing.sweep_candidates(statuses, 9, include_failed=True).collect()] == ["d2", "d4", "d1", "d0", "d3"]
    assert "extracted_text" not in listing.light(statuses.withColumn("extracted_text", F.lit("x"))).columns


def test_totals_on_empty_and_small_tables(spark):
    mails = spark.createDataFrame([("w", "sent", ts("2024-03-10 00:00:00")), ("w", "sent", ts("2024-03-09 23:00:00")), ("v", "pending", None)],
                                  "workspace_id string, status string, sent_at timestamp")
    snapshot = docs(spark, {"status": "approved", "confidence": None}, {"requires_review": True, "confidence": 0.5, "extracted_fields": {"email": "a"}},
                    {"status": "failed", "assigned_to": "u"}, {"workspace_id": "v"})
    got = analytics.analytics_totals(snapshot, mails, now(), "w").first().asDict()
    assert got == {"total_documents": 3, "needs_review": 1, "routed_or_approved": 1, "automated_documents": 1, "average_confidence": 0.3333,
                   "manual_unassigned": 1, "missing_contact_email": 1, "overdue": 0, "emails_sent_today": 1, "manual_documents": 2,
                   "automation_rate": 0.3333, "manual_rate": 0.6667}
    empty = analytics.analytics_totals(snapshot.limit(0), mails.limit(0), now()).first().asDict()
    assert empty["automation_rate"] == 0.0 and empty["average_confidence"] == 0.0 and empty["total_documents"] == 0


def test_queue_and_tenancy(spark):
    snapshot = docs(spark, {"workspace_id": "w1", "department": "A"}, {"workspace_id": "w2"}, {"workspace_id": "w2", "status": "routed"})
    assert rows(analytics.queue_snapshot(snapshot, "w2")) == [("Unassigned", 2, 1, 1)]
    assert analytics.queue_snapshot(snapshot, "w1").first()["total"] == 1
    assert tuple(analytics.queue_totals(analytics.queue_snapshot(snapshot)).first()) == (3, 2, 1)


def test_audit_pages(spark):
    log = spark.createDataFrame([(i, f"d{i % 2}", "a", "x") for i in range(1, 6)], "id int, document_id string, action string, actor string")
    snapshot = docs(spark, {"filename": "zero"})
    first = listing.audit_page(log, snapshot, 1, 0)
    second = listing.audit_page(log, snapshot, 1, 1)
    assert [r["id"] for r in first.collect() + second.collect()] == [5, 4]
    assert second.first()["filename"] == "zero" and first.first()["filename"] is None
    assert listing.audit_total(log, action="b").first()["total"] == 0


def test_default_and_latest(spark):
    members = spark.createDataFrame([("w1", "u", "member"), ("w2", "u", "admin"), ("w3", "u", "admin"), ("w1", "v", "member")], "workspace_id string, user_id string, role string")
    spaces = spark.createDataFrame([("w1", ts("2020-01-01 00:00:00")), ("w2", ts("2022-01-01 00:00:00")), ("w3", ts("2021-01-01 00:00:00"))], "id string, created_at timestamp")
    assert rows(joins.default_workspace(members, spaces), "user_id") == [("u", "w3", "admin"), ("v", "w1", "member")]
    subs = spark.createDataFrame([(1, "u", "free", "active", ts("2020-01-01 00:00:00")), (2, "u", "pro", "past_due", ts("2021-01-01 00:00:00")), (3, "u", "max", "canceled", ts("2022-01-01 00:00:00"))],
                                 "id int, user_id string, plan_tier string, status string, created_at timestamp")
    assert joins.active_subscription(subs, ["user_id"]).first()["plan_tier"] == "pro"
    assert joins.latest_row(subs, ["user_id"], "id").first()["status"] == "canceled"


def test_lists_read_only_what_they_show(spark, tmp_path):
    docs(spark, {}).withColumn("extracted_text", F.lit("long")).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    shown = listing.list_documents(stored, now(), status="needs_review", workspace_id="w", limit=100).select("id", "updated_at")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "extracted_text" not in plan and "EqualTo(status,needs_review)" in plan and "EqualTo(workspace_id,w)" in plan
    assert "TakeOrderedAndProject" in plan
    page = listing.audit_page(spark.createDataFrame([(1, "d0", "a", "x")], "id int, document_id string, action string, actor string"), stored, 5)
    assert "extracted_text" not in page._jdf.queryExecution().executedPlan().toString()
    totals = analytics.queue_snapshot(stored)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<status:string,department:string>" in totals


def test_rows_for_the_logs(spark):
    snapshot = docs(spark, {"status": "routed"}, {"status": "needs_review"})
    requests = spark.createDataFrame([("d0", "approved", None), ("d1", "archived", None)], "document_id string, to_status string, notes string")
    moved = lifecycle.apply_transitions(snapshot, requests)
    assert [r["title"] for r in lifecycle.transition_notifications(moved, snapshot, now()).collect()] == ["f.txt: routed → approved"]
    changed = lifecycle.auto_assign(snapshot)
    assert [r["title"] for r in lifecycle.auto_assignment_notifications(changed, snapshot, now()).collect()] == ["Document assigned: f.txt"]
    assert lifecycle.assignment_audit(changed, "a", now(), "auto_assigned").first()["details"] == "assigned_to=triage_queue"


def test_pages_by_ranges_equal_an_offset(spark):
    rnd = random.Random(3)
    ids = sorted(rnd.sample(range(-5000, 10 ** 12), 300) + list(range(2000)), reverse=True)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    for offset, limit in ((0, 5), (299, 3), (1200, 40), (2298, 5), (2299, 5), (2300, 5), (5000, 1), (10, 0)):
        got = [r["id"] for r in listing.page_by_ranges(df, "id", limit, offset, enough=3).collect()]
        assert got == ids[offset:offset + limit]
    assert listing.page_by_ranges(df.limit(0), "id", 5, 5).count() == 0
