import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.operators.classify import classify, route, validate
from clerkwise.operators import classify as classify_module
from clerkwise.operators import rules as rules_module
from clerkwise.operators import rule_search
from clerkwise.operators.rule_search import classify_by_table
from clerkwise.operators.rules import (
    Rule, default_rules, literal_rules, normalize_rules, rule_errors, rule_key_order, rule_list)
from clerkwise.plans.process import process_documents, processing_audit, reply_sweep, reprocess, review_notifications
from tests.helpers import docs, rows, ts

NOW = "2024-03-10 00:00:00"
PERMIT = ("Building permit\nApplicant: John Doe\nAddress: 12 Main Street\nParcel Number: P-1234\nDate: 02/07/2026\n"
          "site plan and construction")


def texts(spark, *values):
    return spark.createDataFrame([(i, v, ts("2024-03-01 00:00:00")) for i, v in enumerate(values)], "id int, text string, created_at timestamp")


def python_classify(text, rules):
    low, best, hits_best = text.lower(), None, 0
    for rule in rules:
        hits = sum(k in low for k in rule.keywords)
        if hits > hits_best:
            best, hits_best = rule, hits
    return (best.doc_type, [k for k in best.keywords if k in low]) if best else ("other", [])


@pytest.mark.parametrize("unrolled", [True, False])
def test_classify_equals_a_row_loop_with_ties(spark, monkeypatch, unrolled):
    if not unrolled:
        monkeypatch.setattr(classify_module, "UNROLLED_KEYWORDS", 0)
        monkeypatch.setattr(classify_module, "KEYWORDS_PER_LITERAL", 7)
    words = "case court noise report permit parcel foia income showcase LLC petition's zoning variance it's".split()
    rng = random.Random(3)
    values = [" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(400)] + [""]
    rules = [*literal_rules(), Rule("quoted", ("it's", "petition's"), "Desk", ())]
    got = {r["id"]: (r["doc_type"], list(r["matched_keywords"])) for r in classify(texts(spark, *values), rules).collect()}
    assert [got[i] for i in range(len(values))] == [python_classify(v, rules) for v in values]


def test_substring_not_word(spark):
    assert classify(texts(spark, "a showcase"), literal_rules()).first()["doc_type"] == "court_filing"


def test_validate_route_and_fallback(spark):
    df = spark.createDataFrame([
        ("building_permit", {"applicant_name": "J", "date": "1/2"}), ("mystery", {}), ("court_filing", {"applicant_name": "x", "case_number": "c", "date": "2024-01-01"}),
        ("other", {"applicant_name": "x", "date": "", "parcel_number": "bad parcel!"}),
    ], "doc_type string, extracted_fields map<string,string>")
    got = {r["doc_type"]: r for r in validate(route(df, literal_rules()), literal_rules()).collect()}
    assert got["building_permit"]["missing_fields"] == ["address", "parcel_number"]
    assert got["building_permit"]["validation_errors"] == [
        "Missing required field: address", "Missing required field: parcel_number", "Date format looks invalid"]
    assert got["mystery"]["department"] == "General Intake"
    assert got["mystery"]["missing_fields"] == ["applicant_name", "date"]
    assert got["court_filing"]["validation_errors"] == []
    assert got["other"]["validation_errors"] == ["Missing required field: date", "Parcel number format looks invalid"]


def test_rules_are_cleaned_and_completed(spark):
    raw = spark.createDataFrame([
        (" task_sheet ", 0, [" Task ", "task", "", "Sheet"], "  ", [" name ", "name"], " 5 "), ("memo", 1, None, "Desk", None, None),
    ], "doc_type string, rule_order int, keywords array<string>, department string, required_fields array<string>, sla_days string")
    rules = rule_list(normalize_rules(raw))
    assert [r.doc_type for r in rules] == ["task_sheet", "memo", "other"]
    assert rules[0] == Rule("task_sheet", ("task", "sheet"), "General Intake", ("name",), 5)
    assert [r.doc_type for r in rule_list(normalize_rules(raw, alphabetical=True))] == ["memo", "other", "task_sheet"]
    errors = {r["doc_type"]: r["reason"] for r in rule_errors(raw).collect()}
    assert errors == {"memo": "rule 'memo'.keywords must be a list"}


def test_default_rules_round_trip(spark):
    assert rule_list(default_rules(spark)) == literal_rules()
    assert rule_key_order(default_rules(spark)).collect()[-1]["doc_type"] == "other"


def test_custom_rules_drive_processing(spark):
    rules = [Rule("task_sheet", ("task sheet",), "Works", ("applicant_name",), 3), Rule("other", (), "General Intake", ())]
    got = process_documents(texts(spark, "Task sheet\nOwner: Ann Lee", "nothing"), rules, instant(NOW))
    first, second = got.orderBy("id").collect()
    assert (first["doc_type"], first["department"], first["status"], first["due_date"]) == ("task_sheet", "Works", "needs_review", ts("2024-03-04 00:00:00"))
    assert first["confidence"] == 0.73 and first["missing_fields"] == []
    assert (second["doc_type"], second["due_date"]) == ("other", None)


def test_permit_is_routed_and_flags_follow(spark):
    got = process_documents(texts(spark, PERMIT, PERMIT + "\nurgent", "complaint"), literal_rules(), instant(NOW)).orderBy("id").collect()
    assert [g["status"] for g in got] == ["routed", "routed", "needs_review"]
    assert [g["urgency"] for g in got] == ["normal", "high", "normal"]
    assert got[0]["confidence"] > 0.55
    forced = process_documents(texts(spark, PERMIT), literal_rules(), instant(NOW), forced=["BUILDING_PERMIT"]).first()
    assert forced["status"] == "needs_review"


def test_reply_wins_and_bad_reply_does_not(spark):
    replies = spark.createDataFrame([
        (0, '```json\n{"doc_type": "complaint", "confidence": 0.97, "urgency": "high"}\n```'), (1, "sorry"), (2, '[{"doc_type": "complaint"}]x'),
    ], "id int, reply string")
    got = process_documents(texts(spark, PERMIT, PERMIT, PERMIT), literal_rules(), instant(NOW), replies=replies).orderBy("id").collect()
    assert [(g["classified_by"], g["doc_type"], g["department"], g["urgency"]) for g in got] == [
        ("reply", "complaint", "Code Enforcement", "high"), ("rules", "building_permit", "Building Department", "normal"),
        ("reply", "complaint", "Code Enforcement", "normal")]
    assert got[0]["confidence"] == 0.97


def test_enrichment_fills_only_gaps(spark):
    reply = '{"fields": {"address": "9 Elm Street", "date": "unknown", "applicant_name": "Someone Else", "zzz": "1"}, "confidence": 0.9}'
    replies = spark.createDataFrame([(0, reply), (1, reply)], "id int, reply string")
    source = texts(spark, "noise complaint\nApplicant: John Doe", PERMIT)
    got = process_documents(source, literal_rules(), instant(NOW), enrichments=replies).orderBy("id").collect()
    assert got[0]["extracted_fields"] == {"applicant_name": "John Doe", "address": "9 Elm Street"}
    assert got[0]["filled_fields"] == ["address"] and got[0]["missing_fields"] == ["date"]
    assert got[1]["filled_fields"] == []
    got = process_documents(source, literal_rules(), instant(NOW), enrichments=replies, longest=5).orderBy("id").first()
    assert got["extracted_fields"] == {"applicant_name": "John Doe", "address": "9 Elm"}


def test_failures_stay_apart(spark):
    source = texts(spark, PERMIT, PERMIT).withColumn("extraction_error", F.when(F.col("id") == 1, "unreadable"))
    done = process_documents(source, literal_rules(), instant(NOW))
    assert [(r["status"], r["requires_review"], r["doc_type"]) for r in done.orderBy("id").collect()] == [
        ("routed", False, "building_permit"), ("failed", True, None)]
    log = {r["document_id"]: (r["action"], r["details"]) for r in processing_audit(done, "system", instant(NOW)).collect()}
    assert log[1] == ("pipeline_failed", "unreadable")
    assert log[0][1] == "doc_type=building_permit confidence=0.89 requires_review=False threshold=0.82"
    assert review_notifications(done.withColumn("filename", F.lit("f")), instant(NOW)).count() == 0


def test_reprocess_touches_only_the_chosen(spark):
    snapshot = docs(spark, {"status": "failed"}, {"status": "failed"})
    source = spark.createDataFrame([("d0", PERMIT), ("d1", PERMIT)], "id string, text string")
    chosen = spark.createDataFrame([("d0",)], "id string")
    got = reprocess(snapshot, source, chosen, literal_rules(), instant(NOW)).orderBy("id").collect()
    assert [(g["status"], g["doc_type"], g["updated_at"]) for g in got] == [
        ("routed", "building_permit", ts(NOW)), ("failed", None, ts("2024-01-02 00:00:00"))]


def test_reply_sweep_counts(spark):
    snapshot = docs(spark, {"status": "needs_review"}, {"status": "assigned"}, {"status": "approved"})
    source = spark.createDataFrame([(f"d{i}", PERMIT if i != 1 else "x") for i in range(3)], "id string, text string")
    replies = spark.createDataFrame([], "id string, reply string")
    got = reply_sweep(snapshot, source, replies, literal_rules(), instant(NOW), 10).first()
    assert tuple(got) == (2, 1, 1)


def test_processing_needs_no_shuffle(spark):
    plan = process_documents(texts(spark, PERMIT), literal_rules(), instant(NOW))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_columns_nobody_reads_are_not_made(spark):
    from clerkwise.functions.text import FIELD_PATTERNS
    from clerkwise.plans.process import process_documents

    text = "Building permit for construction\nApplicant: John Doe\nAddress: 12 Main Street\nParcel: P-1234\nDate: 02/07/2026\nAmount: $5.00"
    df = spark.createDataFrame([(1, text), (2, "noise complaint"), (3, None)], "id int, text string").withColumn("created_at", instant("2024-01-01 00:00:00"))
    names = ("doc_type", "department", "requires_review", "confidence", "missing_fields", "validation_errors")
    whole = process_documents(df, literal_rules(), instant("2024-03-10 00:00:00")).select("id", *names)
    part = process_documents(df, literal_rules(), instant("2024-03-10 00:00:00"), wanted=names).select("id", *names)
    assert rows(part, "id") == rows(whole, "id")
    plan = part.select("department", "requires_review")._jdf.queryExecution().optimizedPlan().toString()
    assert "matched_keywords" not in plan and FIELD_PATTERNS["amount"][:20] not in plan and FIELD_PATTERNS["date"][:12] in plan


def test_rule_tables_of_any_size_give_the_same(spark, monkeypatch):
    """Blocks of a few rules against the rules inside the plan: hits, ties, doubled and empty keywords, null texts."""
    words = ["permit", "noise", "ice", "é", "a b", "permit", "tax"]
    table = spark.createDataFrame(
        [(f"t{i}", i % 4, [words[(i + k) % len(words)] for k in range(i % 4)], f"desk {i}", ["date"], i) for i in range(12)] + [("other", 99, [], "Desk", ["date"], 3)],
        "doc_type string, rule_order int, keywords array<string>, department string, required_fields array<string>, sla_days int")
    source = texts(spark, "Noise PERMIT", "ice and é", "", "nothing", "a b tax permit noise ice", None).withColumn("extra", F.array(F.lit(1)))
    want = classify(source, table).orderBy("id").collect()
    for size in (1, 300, 1 << 20):
        assert classify_by_table(source, table, block_bytes=size).orderBy("id").collect() == want
    processed = process_documents(source, table, instant(NOW)).orderBy("id").collect()
    monkeypatch.setattr(rules_module, "RULE_TABLE_MAX_ROWS", 5)
    assert classify(source, table).orderBy("id").collect() == want
    columns = ["id", "doc_type", "department", "missing_fields", "sla_days", "status", "confidence"]
    again = process_documents(source, table, instant(NOW)).orderBy("id").collect()
    assert [[r[c] for c in columns] for r in again] == [[r[c] for c in columns] for r in processed]
    assert [r["department"] for r in route(source.withColumn("doc_type", F.lit("t3")).limit(1).unionByName(source.withColumn("doc_type", F.lit("zzz")).limit(1)), table).collect()] == ["desk 3", "Desk"]
    always = spark.createDataFrame([("e", 0, [""]), ("p", 1, ["permit", "x"])], "doc_type string, rule_order int, keywords array<string>")
    assert {r["id"]: r["doc_type"] for r in classify_by_table(source, always).collect()}[3] == "e"


def test_blocks_of_rules_write_the_rows_nowhere(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("the rows were written between blocks")

    monkeypatch.setattr(rule_search, "checkpointed", refuse)
    table = spark.createDataFrame([(f"t{i:02}", i, [f"word{i}x"]) for i in range(40)], "doc_type string, rule_order int, keywords array<string>")
    source = spark.createDataFrame([(i, f"has word{i}x and word39x") for i in range(40)], "id int, text string")
    found = {r["id"]: r["doc_type"] for r in classify_by_table(source, table, block_bytes=200).collect()}
    assert found == {i: f"t{i:02}" for i in range(40)}


def test_one_walk_searches_many_blocks(spark, monkeypatch):
    """A plain loop against searchers that hold all blocks or few: ties, doubled, null and empty keywords, and as few automata as may be."""
    import ahocorasick

    letters = random.Random(4)
    word = lambda: "".join(letters.choice("ab\u00e9") for _ in range(letters.randint(1, 3)))
    rules = [(f"t{i}", letters.choice([None, 1, 2, 3]), [letters.choice([word(), word(), word(), None, ""] if i % 9 == 0 else [word()]) for _ in range(letters.randint(1, 4))])
             for i in range(120)]
    texts_ = ["".join(letters.choice("ab\u00e9 c") for _ in range(letters.randint(0, 12))) for _ in range(80)] + [""]

    def best(text):
        hits = [(-sum(w is not None and w in text for w in words), order is None, order or 0, kind, [w for w in words if w is not None and w in text]) for kind, order, words in rules]
        first = min(h[:4] + (h[4],) for h in hits)
        return (first[3], first[4]) if first[0] else ("other", [])

    table = spark.createDataFrame(rules, "doc_type string, rule_order int, keywords array<string>")
    source = spark.createDataFrame(list(enumerate(texts_)), "id int, text string")
    found = {r["id"]: (r["doc_type"], r["matched_keywords"]) for r in classify_by_table(source, table, block_bytes=500).collect()}
    assert found == {i: best(t) for i, t in enumerate(texts_)}

    blocks = list(rule_search.rule_blocks(table, 500))
    assert len(blocks) > 10
    made, plain = [], ahocorasick.Automaton
    monkeypatch.setattr(ahocorasick, "Automaton", lambda: made.append(1) or plain())
    monkeypatch.setattr(rule_search, "PAIRS", 50)
    schema = pa.schema([("__low", pa.string()), ("__hits", pa.int32()), ("__order", pa.int32()), ("__type", pa.string()), ("__n", pa.int32()), ("__matched", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([{"__low": t, "__hits": 0} for t in texts_[k::3]], schema=schema) for k in range(3)]
    for chars, most in ((1 << 20, 1), (20, 100)):
        made.clear()
        monkeypatch.setattr(rule_search, "SEARCH_CHARS", chars)
        out = [(r["__low"], (r["__type"] or "other", r["__matched"] or [])) for b in rule_search._search(SimpleNamespace(value=blocks))(iter(batches)) for r in b.to_pylist()]
        assert dict(out) == {t: best(t) for t in texts_} and len(made) <= most and (most == 1 or len(made) > 3)
