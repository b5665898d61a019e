import json
import random

from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.operators import mail, sinks, sla, workflows
from clerkwise.plans.change_queries import _many_rules
from clerkwise.plans.views import Views
from tests.helpers import docs, rows, ts

def now():
    return instant("2024-03-10 00:00:00")

RULE = "id long, workspace_id string, name string, enabled boolean, trigger_event string, filters_json string, actions_json string"
TEMPLATE = "id long, workspace_id string, name string, template_body string"


def rule(i, filters=None, actions=(), workspace=None, enabled=True, trigger="go", name="r"):
    return (i, workspace, name, enabled, trigger, filters if isinstance(filters, str) else json.dumps(filters or {}), json.dumps(list(actions)))


def action(kind, **config):
    return {"type": kind, "config": config}


def matched(spark, snapshot, *rules, limit=200):
    table = spark.createDataFrame(list(rules), RULE)
    return sorted((r["document_id"], r["rule_id"]) for r in workflows.match_workflows(snapshot, table, "go", limit).select("document_id", "rule_id").distinct().collect())


ACT = [action("assign", user_id="u")]


def test_a_large_rule_index_is_not_collected_on_the_driver(spark):
    # Few bytes of files, so that Spark itself would broadcast the index.
    many = spark.range(50).selectExpr("id", "cast(null as string) as workspace_id", "'r' as name", "true as enabled", "'go' as trigger_event",
                                      "'{\"status\": \"needs_review\"}' as filters_json", """'[{"type": "assign", "config": {"user_id": "u"}}]' as actions_json""")
    lent, dealt = (workflows.matched_actions(docs(spark, {}, {"status": "routed"}), many, "go", [], small=n) for n in (100, 10))
    assert sorted(rows(lent.select("document_id", "rule_id"))) == sorted(rows(dealt.select("document_id", "rule_id"))) == sorted(("d0", i) for i in range(50))
    plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in (lent, dealt)]
    assert ["BroadcastHashJoin" in plan for plan in plans] == [True, False]


def test_filters(spark):
    snapshot = docs(spark, {"doc_type": "a", "confidence": 0.5}, {"doc_type": None, "confidence": None})
    cases = [({}, 2), ({"doc_type": None}, 2), ({"doc_type": ""}, 2), ({"doc_type": "a"}, 1), ({"doc_type": ["a", "b"]}, 1), ({"doc_type": []}, 0),
             ({"doc_type": ["a", ""]}, 2), ({"min_confidence": 0.5}, 1), ({"max_confidence": "0.5"}, 2), ({"max_confidence": 0.0}, 1), ({"min_confidence": "x"}, 0),
             ({"other": 1}, 2), ("broken", 2), ("[1]", 2), ({"status": "needs_review", "urgency": "high"}, 0)]
    got = matched(spark, snapshot, *[rule(i, f, ACT) for i, (f, _) in enumerate(cases)])
    assert [sum(1 for _, r in got if r == i) for i in range(len(cases))] == [n for _, n in cases]


def test_scope_and_limit(spark):
    snapshot = docs(spark, {"workspace_id": "w1"}, {"workspace_id": "w2"}, {"workspace_id": None})
    table = [rule(1, actions=ACT), rule(2, actions=ACT, workspace="w1"), rule(3, actions=ACT, workspace="w3"), rule(4, actions=ACT, enabled=False),
             rule(5, actions=ACT, trigger="stop"), rule(6, actions=ACT)]
    assert matched(spark, snapshot, *table) == [("d0", 1), ("d0", 2), ("d0", 6), ("d1", 1), ("d1", 6), ("d2", 1), ("d2", 6)]
    assert matched(spark, snapshot, *table, limit=2) == [("d0", 1), ("d0", 2), ("d1", 1), ("d1", 6), ("d2", 1), ("d2", 6)]


def test_large_rule_table_takes_the_shuffle_path(spark, monkeypatch):
    monkeypatch.setattr(workflows, "broadcast_if_small", lambda df, *sizes: df)
    test_scope_and_limit(spark)


def test_every_rule_of_a_scope_applies(spark):
    rules = [rule(i, actions=[action("assign", user_id=f"u{i}")], workspace="w" if i % 2 else None) for i in range(450)]
    got = workflows.match_workflows(docs(spark, {}, {"workspace_id": None}), spark.createDataFrame(rules, RULE), "go")
    assert sorted((r["document_id"], r["count"]) for r in got.groupBy("document_id").count().collect()) == [("d0", 450), ("d1", 225)]


def effects(spark, snapshot, rules, templates=(), spaces=()):
    return workflows.run_workflows(
        snapshot, spark.createDataFrame(list(rules), RULE), spark.createDataFrame(list(templates), TEMPLATE),
        spark.createDataFrame(list(spaces), "id string, owner_id string"), "go", now())


def test_actions_see_one_snapshot_and_the_last_write_wins(spark):
    snapshot = docs(spark, {"status": "needs_review"}, {"status": "needs_review", "assigned_to": "old"})
    rules = [rule(1, actions=[action("assign", assignee="workspace_owner"), action("transition", status="acknowledged", notes=" n ")]),
             rule(2, actions=[action("transition", to_status="APPROVED"), action("transition", status="archived")])]
    got = effects(spark, snapshot, rules, spaces=[("w", "boss")])
    # The second rule still sees needs_review, so approved is an allowed edge and archived is not.
    assert rows(got.documents, "document_id") == [("d0", "boss", "approved", "n"), ("d1", None, "approved", "n")]
    assert got.audit.filter("action = 'workflow_assigned'").count() == 1
    assert got.audit.filter("action = 'workflow_transition'").count() == 4
    after = {r["id"]: r for r in workflows.after_pass(snapshot, got, now()).collect()}
    assert after["d0"]["assigned_to"] == "boss" and after["d1"]["assigned_to"] == "old" and after["d1"]["status"] == "approved"


def test_assign_options(spark):
    snapshot = docs(spark, {"status": "needs_review", "assigned_to": "old"})
    got = effects(spark, snapshot, [rule(1, actions=[action("assign", user_id="new", only_if_unassigned=False, set_status_assigned=False)])])
    assert rows(got.documents) == [("d0", "new", None, None)]
    assert effects(spark, snapshot, [rule(1, actions=[action("assign", user_id="new")])]).documents.count() == 0
    assert effects(spark, docs(spark, {}), [rule(1, actions=[action("assign")])]).documents.count() == 0


def test_notification_text(spark):
    got = effects(spark, docs(spark, {"confidence": 0.0}), [rule(1, actions=[action("create_notification", title="T {{filename}} {{confidence}}", user_id="u"), action("create_notification")])])
    notes = got.notifications.orderBy("pos").collect()
    assert (notes[0]["title"], notes[0]["message"], notes[0]["user_id"], notes[0]["type"]) == ("T f.txt ", "Event: go", "u", "workflow")
    assert notes[1]["title"] == "Workflow event"


def test_template_mail(spark):
    templates = [(1, None, "B Status Update", "body {{id}}"), (2, "w", "A status update", "own {{id}}"), (3, "other", "0 status update", "foreign"), (4, None, "Empty", "")]
    snapshot = docs(spark, {"extracted_fields": {"email": "a@b.c"}}, {"extracted_fields": {}}, {"extracted_fields": {"email": "a@b.c"}, "workspace_id": None})
    hint = [rule(1, actions=[action("send_template_email", template_name_hint=" STATUS ")])]
    got = effects(spark, snapshot, hint, templates).outbox
    assert rows(got.select("document_id", "subject", "body"), "document_id") == [
        ("d0", "A status update - f.txt", "own d0"), ("d2", "0 status update - f.txt", "foreign")]
    by_id = [rule(1, actions=[action("send_template_email", template_id=1), action("send_template_email", template_id=3), action("send_template_email", template_id="4")])]
    assert rows(effects(spark, snapshot, by_id, templates).outbox.select("document_id", "body"), "document_id", "body") == [("d0", "body d0"), ("d2", "body d2"), ("d2", "foreign")]


def test_webhook_rows(spark):
    got = effects(spark, docs(spark, {}), [rule(1, actions=[action("webhook_post", url=" https://x "), action("webhook_post")])]).webhooks.collect()
    payload = json.loads(got[0]["payload"])
    assert len(got) == 1 and got[0]["url"] == "https://x" and payload["event"] == "go" and payload["document"]["doc_type"] is None


def test_presets(spark):
    rules = spark.createDataFrame([rule(1, workspace="w", name="contracts: notify when OVERDUE ", trigger="document_overdue")], RULE)
    templates = spark.createDataFrame([(1, None, "foia status update", "x")], TEMPLATE)
    new_rules, _, counts = workflows.apply_preset("biz-contracts", "w", rules, templates)
    assert [r["name"] for r in new_rules.collect()] == ["Contracts: Auto-assign on ingestion"]
    assert {r["kind"]: (r["created"], r["skipped"]) for r in counts.collect()} == {"rules": (1, 1), "templates": (0, 0)}
    _, none, counts = workflows.apply_preset("gov-foia", "w", rules, templates)
    assert none.count() == 0
    assert {r["kind"]: (r["created"], r["skipped"]) for r in counts.collect()} == {"rules": (3, 0), "templates": (0, 1)}


def test_sla_scan_and_escalation(spark):
    late = ts("2024-03-06 12:00:00")
    snapshot = docs(spark, {"due_date": late}, {"due_date": late, "assigned_to": "boss"}, {"due_date": late, "assigned_to": "u"}, {"due_date": ts("2024-03-09 00:00:00")}, {})
    notes = spark.createDataFrame([("d0", "overdue", ts("2024-03-09 00:00:00")), ("d1", "overdue", ts("2024-03-08 23:59:59")), ("d2", "other", ts("2024-03-09 12:00:00"))],
                                  "document_id string, type string, created_at timestamp")
    scanned = sla.sla_scan(snapshot, notes, now())
    assert rows(scanned.select("id", "days_overdue"), "id") == [("d1", 3), ("d2", 3), ("d3", 1)]
    told = {r["document_id"]: r for r in sla.overdue_notifications(scanned, now()).collect()}
    assert told["d2"]["message"] == "SLA due date passed (2024-03-06T12:00:00+00:00). 3d overdue." and told["d2"]["user_id"] == "u"
    moved = sla.escalate(scanned, "boss", now()).collect()
    assert [(m["document_id"], m["details"]) for m in moved] == [("d2", "Reassigned from u to boss (3d overdue)")]
    assert sla.escalate(scanned, "", now()).count() == 0
    assert sla.sla_scan(snapshot, notes, now(), limit=1).count() == 0


def test_automatic_mail(spark):
    templates = spark.createDataFrame([(1, None, "Z Acknowledgment", "z"), (2, None, "Acknowledgment letter", "ack {{filename}}"), (3, None, "Request for Information", "info")], TEMPLATE)
    mails = {"extracted_fields": {"email": "a@b.c"}}
    snapshot = docs(spark, {**mails, "missing_fields": ["date"]}, {**mails, "status": "approved"}, {})
    got = rows(mail.auto_mail(snapshot, templates, now()).select("document_id", "email_type", "body"), "document_id", "email_type")
    # No template answers to the status update hint, so that mail is left out.
    assert got == [("d0", "acknowledgment", "ack f.txt"), ("d0", "missing_info", "info"), ("d1", "acknowledgment", "ack f.txt")]


USER = "id string, email string, full_name string, email_preferences string"


def test_user_and_account_mail(spark):
    users = spark.createDataFrame([("u1", "ann@x.y", None, None), ("u2", "bob@x.y", "Bob", '{"doc_assigned": false, "account_welcome": false}')], USER)
    events = spark.createDataFrame([("d0", "u1"), ("d0", "u2"), ("d0", "u3")], "document_id string, user_id string")
    got = mail.user_mail(events, docs(spark, {}), users, "doc_assigned", "Desk", now()).collect()
    assert [(g["to_email"], g["subject"]) for g in got] == [("ann@x.y", "Desk: document assigned to you: f.txt")]
    assert got[0]["body"].startswith("Hi ann,") and "Type: None" in got[0]["body"]
    signups = spark.createDataFrame([(None, "bob@x.y", "Bob"), ("u1", "ann@x.y", None), (None, "new@x.y", None)], "user_id string, email string, full_name string")
    welcome = mail.account_mail(signups, users, "account_welcome", "Desk", now())
    assert sorted(r["to_email"] for r in welcome.collect()) == ["ann@x.y", "new@x.y"]
    paid = spark.createDataFrame([("u1", "ann@x.y", "pro", 2900)], "user_id string, email string, plan_tier string, amount_cents long")
    assert "$29.00 for the Pro plan" in mail.account_mail(paid, users, "account_payment_receipt", "Desk", now()).first()["body"]
    invited = spark.createDataFrame([(None, "z@z.z", "https://join")], "user_id string, email string, link string")
    assert "An administrator invites you to Desk" in mail.account_mail(invited, users, "account_invitation", "Desk", now()).first()["body"]


def test_exports(spark, tmp_path):
    snapshot = docs(spark, {"status": " Approved", "filename": 'a "q".txt'}, {"status": "corrected", "storage_path": ""}, {"status": "routed"})
    meta = sinks.approved_export(snapshot, "/out", "review", now())
    assert [(r["document_id"], r["status"], r["export_path"]) for r in meta.collect()] == [("d0", "approved", '/out/d0_a "q".txt')]
    content = spark.createDataFrame([("d0", bytearray(b"x")), ("d1", bytearray(b"y"))], "document_id string, content binary")
    for _ in range(2):
        sinks.write_export(meta, content, str(tmp_path / "export"), "1")
    other = sinks.approved_export(docs(spark, {"id": "d1", "status": "approved"}, {"id": "d0", "status": "corrected"}), "/out", "again", now())
    sinks.write_export(other, content, str(tmp_path / "export"), "2")
    stored, bodies = sinks.read_export(spark, str(tmp_path / "export"))
    assert rows(stored.select("document_id", "status"), "document_id") == [("d0", "corrected"), ("d1", "approved")]
    assert rows(bodies.select("document_id", F.col("content").cast("string")), "document_id") == [("d0", "x"), ("d1", "y")]
    sinks.write_csv(snapshot.limit(1), str(tmp_path / "csv"))
    lines = [line.value for line in spark.read.text(str(tmp_path / "csv")).collect()]
    assert '"d0","a ""q"".txt"," Approved","","","",""' in lines
    assert sinks.csv_lines(snapshot.limit(1)).first()["line"] in lines
    log = spark.createDataFrame([(1, ts("2024-01-01 10:00:00")), (2, ts("2024-01-02 10:00:00"))], "id int, created_at timestamp")
    for batch in ("b1", "b1", "b2"):
        sinks.append_log(log, str(tmp_path / "log"), batch)
    kept = spark.read.parquet(str(tmp_path / "log")).filter("day >= '2024-01-02'")
    assert kept.count() == 2 and "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().executedPlan().toString()


def test_processed_copies(spark, tmp_path):
    files = spark.createDataFrame([("d0", "a.txt", bytearray(b"x")), ("d1", "b.txt", bytearray(b"y"))], "id string, filename string, content binary")
    for run, changes in (("1", [{"status": "routed"}]), ("1", [{"status": "routed"}]), ("2", [{"id": "d1", "status": "failed"}]), ("3", [{"status": "approved"}])):
        sinks.write_processed_copy(files, docs(spark, *changes), str(tmp_path / "out"), run)
    got = sinks.read_processed_copies(spark, str(tmp_path / "out")).select("filename", "status")
    assert rows(got, "filename") == [("a.txt", "approved"), ("b.txt", "failed")]


def test_the_last_run_is_the_greatest_number(spark, tmp_path):
    files = spark.createDataFrame([("d0", "a.txt", bytearray(b"x"))], "id string, filename string, content binary")
    for run, status in (("9", "routed"), ("10", "approved"), ("night", "failed")):
        sinks.write_processed_copy(files, docs(spark, {"status": status}), str(tmp_path / "out"), run)
    assert [r["status"] for r in sinks.read_processed_copies(spark, str(tmp_path / "out")).collect()] == ["approved"]


def test_rules_are_found_through_the_index(spark):
    """Every filter alone and together, several values, bounds, and more values than a rule may have entries."""
    rnd = random.Random(4)
    kinds, states, urgencies = ["a", "b", "", None, "c"], ["needs_review", "routed", None], ["high", "normal"]
    snapshot = docs(spark, *[{"doc_type": rnd.choice(kinds), "status": rnd.choice(states), "urgency": rnd.choice(urgencies), "confidence": rnd.choice([None, 0.0, 0.1, 0.3, 0.55, 0.999, 1.0, 1.7, float("nan")]),
                              "department": rnd.choice(["x", "y", None]), "workspace_id": rnd.choice(["w", "v", None])} for _ in range(60)])
    rules = []
    for i in range(150):
        filters = {}
        if rnd.random() < 0.5:
            filters["doc_type"] = rnd.choice(["a", ["a", "b"], [], ["", "c"], [f"t{k}" for k in range(70)] + ["b"], ["a", "a"]])
        if rnd.random() < 0.5:
            filters["status"] = rnd.choice(["routed", ["routed", "needs_review"], ""])
        if rnd.random() < 0.3:
            filters["urgency"] = ["high", "normal"][:rnd.randrange(1, 3)]
        if rnd.random() < 0.4:
            filters["min_confidence"] = rnd.choice([0.1, 0.3, "0.5", 1.0, -1, 2])
        if rnd.random() < 0.4:
            filters["max_confidence"] = rnd.choice([0.1, 0.55, 1, 0.0, 3])
        rules.append(rule(i, filters, ACT, workspace=rnd.choice([None, "w"])))
    got = matched(spark, snapshot, *rules, limit=None)
    want = []
    for d in snapshot.collect():
        for i, workspace, _, _, _, text, _ in rules:
            f = json.loads(text)
            score = d["confidence"] if d["confidence"] is not None else 0.0
            number = score != score
            fits = workspace is None or workspace == d["workspace_id"]
            for name in ("doc_type", "status", "urgency"):
                if f.get(name, "") != "":
                    fits = fits and (d[name] or "") in ([f[name]] if isinstance(f[name], str) else f[name])
            low, high = (float(f[k]) if k in f else None for k in ("min_confidence", "max_confidence"))
            # What is not a number counts as greater than any.
            fits = fits and (low is None or number or score >= low) and (high is None or (not number and score <= high))
            want += [(d["id"], i)] * fits
    assert got == sorted(want) and len(want) > 500


def test_the_index_compares_little(spark):
    """Rules of one value each: documents meet those of their own values only."""
    rules = spark.createDataFrame([rule(i, {"doc_type": f"t{i}", "status": "routed", "min_confidence": 0.42, "max_confidence": 0.43}, ACT) for i in range(400)], RULE)
    indexed = workflows.index_rules(workflows.parse_rules(workflows.live_rules(rules, "go")))
    assert indexed.count() == 400 and {r["shape"] for r in indexed.collect()} == {"101001"}
    many = workflows.index_rules(workflows.parse_rules(workflows.live_rules(spark.createDataFrame([rule(1, {"doc_type": [f"t{k}" for k in range(65)], "status": ["a", "b"]}, ACT)], RULE), "go")))
    assert [(r["shape"], r["key_doc_type"], r["key_status"]) for r in many.orderBy("key_status").collect()] == [("001000", "", "a"), ("001000", "", "b")]
    plan = workflows.match_workflows(docs(spark, {}), rules, "go")._jdf.queryExecution().optimizedPlan().toString()
    assert "key_doc_type" in plan and "Cartesian" not in plan


def test_actions_are_named_before_documents_meet_them(spark):
    """What does not hang on the document is done for each rule, not for each pair; rules of no valid bound meet nobody."""
    many = [f"t{k}" for k in range(70)]
    rules = [rule(1, {"doc_type": ["t1", "t2"], "status": "routed"}, [action(" Assign ", assignee="u"), {"type": None}, {"type": "create_notification", "config": None}]),
             rule(2, {"doc_type": many}, [action("webhook_post", url="x")]), rule(3, {"min_confidence": "high"}, ACT), rule(4, {}, [])]
    snapshot = docs(spark, {"doc_type": "t1", "status": "routed"}, {"doc_type": "t69", "status": "routed"}, {"doc_type": "t70", "status": "routed"}, {"status": "routed"})
    found = workflows.match_workflows(snapshot, spark.createDataFrame(rules, RULE), "go")
    assert [(r["document_id"], r["rule_id"], r["pos"], r["action_type"], r["config"]) for r in found.orderBy("document_id", "rule_id", "pos").collect()] == [
        ("d0", 1, 0, "assign", {"assignee": "u"}), ("d0", 1, 1, "", {}), ("d0", 1, 2, "create_notification", {}), ("d0", 2, 0, "webhook_post", {"url": "x"}), ("d1", 2, 0, "webhook_post", {"url": "x"})]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join Inner") < plan.index("posexplode") and "bad_min_confidence" not in plan.split("posexplode")[0]


def test_a_large_rule_table_is_parsed_on_all_cores(spark, tmp_path):
    spark.range(300).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rules = _many_rules(Views(spark, str(tmp_path)))
    assert rules.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1 and rules.distinct().count() == 300


def test_effects_read_their_tables_once(spark, tmp_path):
    snapshot = docs(spark, {"status": "needs_review", "extracted_fields": {"email": "a@b.c"}})
    rules = [rule(1, actions=[action("assign", assignee="workspace_owner"), action("create_notification"), action("send_template_email", template_id=1),
                              action("webhook_post", url="https://x"), action("transition", status="approved")])]
    made = effects(spark, snapshot, rules, [(1, None, "T", "b")], [("w", "boss")])
    plan = made.audit._jdf.queryExecution().analyzed().toString().splitlines()
    assert sum("LogicalRDD" in line and "storage_path" in line for line in plan) == 1
    kept = made.stored(str(tmp_path / "rows"))
    for name in ("audit", "notifications", "outbox", "webhooks", "documents"):
        assert sorted(map(str, getattr(kept, name).collect())) == sorted(map(str, getattr(made, name).collect())) != []


def test_stored_effects_are_narrow_and_compiled(spark, tmp_path):
    """The table of effects leaves out what no effect reads, and no effect is computed inside an explode, which would be interpreted."""
    snapshot = docs(spark, {"status": "needs_review", "extracted_fields": {"email": "a@b.c", "n": "1"}, "confidence": 0.5}, {"workspace_id": None, "filename": None})
    acts = [action("assign", user_id="u"), action("create_notification", title="{{filename}} {{n}} {{status}}"), action("webhook_post", url="https://x")]
    for trigger in ("go", None):
        made = workflows.run_workflows(snapshot, spark.createDataFrame([rule(1, actions=acts, trigger=trigger or "document_needs_review")], RULE),
                                       spark.createDataFrame([], TEMPLATE), spark.createDataFrame([("w", "boss")], "id string, owner_id string"), trigger, now())
        plan = made.rows(*workflows.EFFECTS)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert [line for line in plan if "Generate explode(array(" in line and "__made" in line] != []
        assert [line for line in plan if "Generate explode(array(" in line and "new_assignee" in line] == []
        kept = made.stored(str(tmp_path / f"rows-{trigger}"))
        assert kept.kept.columns == list(workflows.STORED) and "extracted_fields" not in kept.kept.columns
        for name in ("audit", "notifications", "outbox", "webhooks", "documents"):
            assert sorted(map(str, getattr(kept, name).collect())) == sorted(map(str, getattr(made, name).collect()))
        assert {r["title"] for r in kept.notifications.filter("type = 'workflow'").collect()} == {"f.txt 1 needs_review", " {{n}} needs_review"}


def test_presets_for_many_workspaces(spark):
    chosen = spark.createDataFrame([("w", "gov-foia"), ("w", "gov-permits"), ("w", "gov-foia"), ("v", "gov-foia"), ("v", "unknown")], "workspace_id string, preset_id string")
    rules = spark.createDataFrame([rule(1, workspace="v", name="foia: auto-ASSIGN on ingestion", trigger="document_ingested"), rule(2, workspace=None, name="FOIA: Notify when overdue", trigger="document_overdue")], RULE)
    templates = spark.createDataFrame([(1, "v", " foia status update", "x"), (2, None, "permit decision notice", "x")], TEMPLATE)
    new_rules, new_templates, counts = workflows.apply_presets(chosen, rules, templates)
    assert {(r["workspace_id"], r["preset_id"], r["kind"]): (r["created"], r["skipped"]) for r in counts.collect()} == {
        ("w", "gov-foia", "rules"): (3, 0), ("w", "gov-foia", "templates"): (1, 0), ("w", "gov-permits", "rules"): (2, 0), ("w", "gov-permits", "templates"): (0, 1),
        ("v", "gov-foia", "rules"): (2, 1), ("v", "gov-foia", "templates"): (0, 1), ("v", "unknown", "rules"): (0, 0), ("v", "unknown", "templates"): (0, 0)}
    assert new_rules.count() == 7 and [tuple(r) for r in new_templates.select("workspace_id", "name").collect()] == [("w", "FOIA Status Update")]


def test_mail_uses_templates_of_its_own_workspace(spark):
    templates = spark.createDataFrame([(1, "other", "A Acknowledgment", "foreign"), (2, "w", "B Acknowledgment", "own"), (3, None, "C Acknowledgment", "shared")], TEMPLATE)
    mails = {"extracted_fields": {"email": "a@b.c"}}
    snapshot = docs(spark, {**mails}, {**mails, "workspace_id": "x"}, {**mails, "workspace_id": None})
    assert rows(mail.auto_mail(snapshot, templates, now()).select("document_id", "body"), "document_id") == [("d0", "own"), ("d1", "shared"), ("d2", "foreign")]
