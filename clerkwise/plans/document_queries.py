"""Queries over document text: extraction, rules, replies, processing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from clerkwise.functions import scores
from clerkwise.functions.codec import json_list, json_object, mail_options, updated_mail_options
from clerkwise.functions.dates import money
from clerkwise.functions.rendering import event_context, letter_context, recipient, render
from clerkwise.functions.text import (
    FIELD_PATTERNS, basename, doc_type_key, extension, mask_pii, mime_guess, provider_mime)
from clerkwise.operators.analytics import queue_snapshot
from clerkwise.operators.classify import classify, route, validate
from clerkwise.operators.replies import flatten_ocr, normalise_enrichment, normalise_replies, with_payload
from clerkwise.operators.rule_search import classify_by_table, with_attributes
from clerkwise.operators.rules import Rule, literal_rules, lookup, normalize_rules, rule_errors, rule_key_order
from clerkwise.plans.catalog import catalog, joined
from clerkwise.plans.duck import SLA, SLA_CASE, URGENT, case_by_type, judged, pattern, pick, sql
from clerkwise.plans.process import (
    extract_field_map, extract_fields, process_documents, processing_audit, reply_sweep, reprocess, reupload, review_notifications)
from clerkwise.plans.views import Views
from clerkwise.sources.files import extract_text

RULES = literal_rules(SLA)

# Words that do occur in the given texts, for a classification of whole documents.
TEXT_RULES = [
    Rule("licence", ("license", "mit license", "apache", "all rights reserved"), "Legal", ("email",)),
    Rule("security", ("token", "password", "secret", "key"), "Security", ()),
    Rule("other", (), "General Intake", ()),
]


def processed(v: Views):
    return process_documents(v.wide.intake_docs, RULES, v.as_of)


@catalog.add("queue_snapshot", sql("""SELECT department, count(*) AS total, count_if(requires_review)::BIGINT AS needs_review,
    count_if(NOT requires_review)::BIGINT AS ready FROM processed GROUP BY department"""))
def _(v):
    return queue_snapshot(process_documents(v.wide.intake_docs, RULES, v.as_of, wanted=("department", "requires_review")))


@catalog.add("processed_documents", sql("""SELECT id, doc_type, department, urgency, confidence, requires_review,
    CASE WHEN requires_review THEN 'needs_review' ELSE 'routed' END AS status, missing_fields, validation_errors,
    sla_days, created_at + to_days(sla_days) AS due_date FROM processed"""))
def _(v):
    return processed(v).select("id", "doc_type", "department", "urgency", "confidence", "requires_review", "status",
                               joined("missing_fields").alias("missing_fields"),
                               joined("validation_errors", ";").alias("validation_errors"), "sla_days", "due_date")


@catalog.add("classify_rules", sql("SELECT id, doc_type, cc AS classification_confidence, matched_keywords FROM classified"))
def _(v):
    return classify(v.wide.intake_docs, RULES).select("id", "doc_type", "classification_confidence",
                                                 joined("matched_keywords").alias("matched_keywords"))


@catalog.add("extract_fields", sql(f"SELECT id, {', '.join(FIELD_PATTERNS)} FROM fields"))
def _(v):
    return extract_fields(v.wide.intake_docs).select("id", *FIELD_PATTERNS)


@catalog.add("documents_fields", "SELECT doc_id, " + ", ".join(
    f"nullif(trim(regexp_extract(text, {pattern(n)}, 1)), '') AS {n}" for n in FIELD_PATTERNS) + " FROM documents")
def _(v):
    return extract_fields(v.wide.table("documents")).select("doc_id", *FIELD_PATTERNS)


def _text_score(n: int, total: int) -> str:
    return f"{0.65 if n == 1 else 0.78}::DOUBLE + ({n}.0::DOUBLE / {total}) * 0.08"


@catalog.add("documents_classified", f"""
    SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'other' WHEN a >= b THEN 'licence' ELSE 'security' END AS doc_type,
      round(CASE greatest(a, b) WHEN 0 THEN 0.45 WHEN 1 THEN {_text_score(1, 4)} WHEN 2 THEN {_text_score(2, 4)}
        ELSE 0.86::DOUBLE + least((greatest(a, b) - 3) * 0.03::DOUBLE, 0.1) END, 4) AS classification_confidence
    FROM (SELECT doc_id, contains(low, 'license')::INT + contains(low, 'mit license')::INT + contains(low, 'apache')::INT
        + contains(low, 'all rights reserved')::INT AS a,
        contains(low, 'token')::INT + contains(low, 'password')::INT + contains(low, 'secret')::INT + contains(low, 'key')::INT AS b
      FROM (SELECT doc_id, lower(text) AS low FROM documents))""")
def _(v):
    return classify(v.wide.table("documents"), TEXT_RULES).select("doc_id", "doc_type", "classification_confidence")


@catalog.add("validate_missing", sql("SELECT id, doc_type, missing_fields, validation_errors FROM processed"))
def _(v):
    docs = extract_field_map(v.wide.intake_docs.withColumn("__lowered", F.lower("text")))
    docs = classify(docs, RULES, lowered="__lowered")
    return validate(docs, RULES).select("id", "doc_type", joined("missing_fields").alias("missing_fields"),
                                        joined("validation_errors", ";").alias("validation_errors"))


@catalog.add("route_department", sql(f"""SELECT id, {case_by_type(2, "'General Intake'")} AS department FROM doc_ledger"""))
def _(v):
    return route(v.doc_ledger, RULES).select("id", "department")


@catalog.add("urgency", sql(f"SELECT id, CASE WHEN {URGENT} THEN 'high' ELSE 'normal' END AS urgency FROM intake_docs"))
def _(v):
    return v.wide.intake_docs.select("id", scores.urgency(F.lower("text")).alias("urgency"))


@catalog.add("review_flags", sql(f"""SELECT id, confidence, requires_review FROM (
    {judged("classified", "0.7", "'benefits_application', 'other'")})"""))
def _(v):
    return process_documents(v.wide.intake_docs, RULES, v.as_of, threshold=0.7, forced=("Benefits_Application", "other"),
                             wanted=("confidence", "requires_review")).select(
        "id", "confidence", "requires_review")


@catalog.add("normalized_rules", """
    SELECT p_type || '-' || p_partkey AS doc_type, array_to_string(list_filter([lower(p_name), lower(p_brand)], lambda w: w <> ''), ',') AS keywords,
      CASE WHEN p_partkey % 3 = 0 THEN 'General Intake' ELSE p_brand END AS department, 'applicant_name,date' AS required_fields,
      CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN NULL ELSE p_size END AS sla_days FROM part
    UNION ALL SELECT 'other', '', 'General Intake', 'applicant_name,date', NULL""")
def _(v):
    p = v.table("part")
    key = F.col("p_partkey")
    raw = p.select(
        F.concat(F.lit("  "), "p_type", F.lit("-"), key.cast("string"), F.lit("\t")).alias("doc_type"), key.cast("int").alias("rule_order"),
        F.array(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")), F.col("p_name"), F.lit("  "), F.col("p_brand")).alias("keywords"),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.concat(F.col("p_brand"), F.lit(" "))).alias("department"),
        F.array(F.lit(" applicant_name"), F.lit("date "), F.lit("date")).alias("required_fields"),
        F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit("soon")).otherwise(F.col("p_size").cast("string")).alias("sla_days"))
    return normalize_rules(raw).select("doc_type", joined("keywords").alias("keywords"), "department",
                                       joined("required_fields").alias("required_fields"), "sla_days")


@catalog.add("rule_errors", """
    SELECT CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS doc_type,
      CASE WHEN p_partkey % 5 = 0 THEN 'document type keys cannot be empty'
        WHEN p_partkey % 5 = 1 THEN 'rule ''' || p_type || '''.keywords must be a list'
        ELSE 'rule ''' || p_type || '''.sla_days must be a whole number' END AS reason
    FROM part WHERE p_partkey % 5 IN (0, 1, 2)""")
def _(v):
    key = F.col("p_partkey")
    raw = v.table("part").select(
        F.when(key % 5 == 0, "").otherwise(F.col("p_type")).alias("doc_type"),
        F.when(key % 5 != 1, F.array("p_name")).alias("keywords"), F.array(F.lit("date")).alias("required_fields"),
        F.when(key % 5 == 2, "soon").alias("sla_days"))
    return rule_errors(raw)


@catalog.add("rule_key_order", """
    SELECT doc_type, row_number() OVER (ORDER BY (doc_type = 'other')::INT, doc_type) AS place FROM (
      SELECT DISTINCT CASE WHEN p_type = 'ECONOMY' THEN 'other' ELSE p_type END AS doc_type FROM part)""")
def _(v):
    from clerkwise.session import number_rows

    keys = v.table("part").select(F.when(F.col("p_type") == "ECONOMY", "other").otherwise(F.col("p_type")).alias("doc_type")).distinct()
    ordered = rule_key_order(keys).withColumn("last", F.col("doc_type") == "other")
    return number_rows(ordered, ["last", "doc_type"], "place").select("doc_type", F.col("place").cast("long").alias("place"))


@catalog.add("mask_pii", r"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '***@\2', 'g'),
      '\b(cs_[A-Za-z0-9_\-]{10,})\b', 'cs_***redacted***', 'g') AS text
    FROM (SELECT doc_id, text || ' cs_' || lpad(doc_id::VARCHAR, 12, '0') || ' cs_short' AS text FROM documents)""")
def _(v):
    d = v.wide.table("documents")
    text = F.concat("text", F.lit(" cs_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(" cs_short"))
    return d.select("doc_id", mask_pii(text).alias("text"))


@catalog.add("template_render", sql("""SELECT l.id, l.letter || t.p_brand AS body FROM letters l JOIN templates t ON t.id = l.id"""))
def _(v):
    t = v.templates.select(F.col("id").alias("tid"), "template_body")
    both = v.wide.doc_ledger.join(t, F.col("id") == F.col("tid"))
    return both.select("id", render(F.col("template_body"), letter_context(), F.col("extracted_fields")).alias("body"))


@catalog.add("event_render", sql("""
    SELECT id, filename || '|' || coalesce(doc_type, '') || '|' || CASE WHEN confidence = 0 THEN '' ELSE confidence::VARCHAR END || '|'
      || coalesce(assigned_to, '') || '|' || coalesce(strftime(due_date, '%Y-%m-%dT%H:%M:%S+00:00'), '') || '|'
      || coalesce(email, '{{email}}') || '|{{nothing}}|' || source_channel AS message FROM doc_ledger"""))
def _(v):
    body = F.lit("{{filename}}|{{doc_type}}|{{confidence}}|{{assigned_to}}|{{due_date}}|{{email}}|{{nothing}}|{{source_channel}}")
    return v.doc_ledger.select("id", render(body, event_context(), F.col("extracted_fields")).alias("message"))


@catalog.add("recipient_resolve", sql("SELECT id, to_email FROM letters"))
def _(v):
    return v.doc_ledger.select("id", recipient(F.col("extracted_fields")).alias("to_email"))


@catalog.add("doc_type_keys", r"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim('  ' || p_name || ' / ' || p_brand || '!! ')), '\s+', '_', 'g'),
      '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS doc_type_key FROM part""")
def _(v):
    name = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit("!! "))
    return v.table("part").select("p_partkey", doc_type_key(name).alias("doc_type_key"))


_PATHS = ("a/b/Doc.TXT", "noext", "dir/.hidden", "x.tar.gz", "in/scan.Jpeg", "end.")


@catalog.add("file_names", f"""
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Doc.TXT' WHEN 2 THEN '.hidden' WHEN 4 THEN 'scan.Jpeg' ELSE {pick(_PATHS, 'doc_id % 6')} END AS name,
      {pick(('txt', '', '', 'gz', 'jpeg', ''), 'doc_id % 6')} AS ext,
      CASE doc_id % 6 WHEN 0 THEN 'text/plain' WHEN 4 THEN 'image/jpeg' END AS mime,
      CASE WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 6 = 4 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS provider
    FROM documents""")
def _(v):
    from clerkwise.plans.views import pick as choose

    path = choose(_PATHS, F.col("doc_id") % 6)
    given = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.lit(""))
    return v.table("documents").select("doc_id", basename(path).alias("name"), extension(path).alias("ext"),
                                       mime_guess(path).alias("mime"), provider_mime(path, given).alias("provider"))


@catalog.add("json_codec", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') END AS k,
      CASE event_id % 4 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS keys, CASE event_id % 4 WHEN 1 THEN 'a,b' ELSE '' END AS items FROM events""")
def _(v):
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, '["a", "b"]').when(F.col("event_id") % 4 == 2, "{bad")
    parsed = v.table("events").select("event_id", json_object(raw).alias("o"), json_list(raw).alias("l"))
    return parsed.select("event_id", F.try_element_at("o", F.lit("k")).alias("k"), F.size("o").cast("long").alias("keys"),
                         F.array_join(F.filter("l", lambda x: ~x.startswith("{")), ",").alias("items"))


@catalog.add("mail_options", sql("""
    SELECT id, k % 5 <> 0 AS doc_assigned, k % 5 <> 1 AS doc_review_complete, k % 5 <> 1 AS account_welcome, true AS doc_digest,
      k % 5 = 0 AS custom, false AS changed_digest, k % 5 = 0 AS keeps_custom, false AS took_unknown FROM users"""))
def _(v):
    own = mail_options(F.col("email_preferences"))
    new = updated_mail_options(F.col("email_preferences"), F.lit('{"doc_digest": false, "other": true}'))

    def on(options, key):
        return F.coalesce(F.try_element_at(options, F.lit(key)) == "true", F.lit(False))

    return v.users.select("id", on(own, "doc_assigned").alias("doc_assigned"), on(own, "doc_review_complete").alias("doc_review_complete"),
                          on(own, "account_welcome").alias("account_welcome"), on(own, "doc_digest").alias("doc_digest"),
                          on(own, "custom").alias("custom"), on(new, "doc_digest").alias("changed_digest"),
                          F.map_contains_key(new, "custom").alias("keeps_custom"), F.map_contains_key(new, "other").alias("took_unknown"))


@catalog.add("reply_payload", """
    SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Complaint' WHEN 1 THEN 'mystery' WHEN 3 THEN 'court_filing' END AS doc_type
    FROM orders WHERE o_orderkey % 6 <> 2""")
def _(v):
    payload = F.try_parse_json("payload")
    return with_payload(v.wide.replies, "reply", "payload").select("id", F.trim(F.try_variant_get(payload, "$.doc_type", "string")).alias("doc_type"))


_REPLY_SQL = """(SELECT o_orderkey AS rid, CASE o_orderkey % 6 WHEN 0 THEN 'complaint' WHEN 1 THEN 'other' WHEN 3 THEN 'court_filing' END AS r_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'Code Enforcement' WHEN 1 THEN 'Desk ' || o_orderpriority WHEN 3 THEN 'Municipal Court' END AS r_dept,
  CASE o_orderkey % 6 WHEN 0 THEN 'high' ELSE 'normal' END AS r_urgency,
  CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 100) / 100.0::DOUBLE WHEN 1 THEN 0.5 WHEN 3 THEN 0.99 END AS r_conf,
  CASE o_orderkey % 6 WHEN 0 THEN 'a,b' ELSE '' END AS r_words FROM orders WHERE o_orderkey % 6 IN (0, 1, 3))"""


@catalog.add("reply_normalise", f"""SELECT rid AS id, r_type AS reply_doc_type, r_dept AS reply_department, r_urgency AS reply_urgency,
    r_conf AS reply_confidence, r_words AS reply_keywords, CASE WHEN rid % 6 = 0 THEN 'r' END AS reply_rationale FROM {_REPLY_SQL}""")
def _(v):
    return normalise_replies(v.wide.replies, RULES, keywords=20).filter("reply_doc_type is not null").select(
        "id", "reply_doc_type", "reply_department", "reply_urgency", "reply_confidence", joined("reply_keywords").alias("reply_keywords"),
        "reply_rationale")


@catalog.add("enrichment_normalise", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Jane ' || o_orderkey END AS applicant_name,
      CASE WHEN o_orderkey % 4 = 1 THEN rtrim(substr(repeat('12 Long Road ', 30), 1, 240)) END AS address,
      CASE WHEN o_orderkey % 4 = 1 THEN 'P' || o_orderkey END AS parcel_number, CASE WHEN o_orderkey % 4 = 0 THEN 'j@x.org' END AS email,
      CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN o_orderkey % 4 = 0 THEN 0.7 ELSE 0 END::DOUBLE AS confidence,
      CASE WHEN o_orderkey % 4 = 0 THEN 'n' END AS notes FROM orders""")
def _(v):
    required = F.array(*[F.lit(x) for x in ("applicant_name", "address", "parcel_number", "date")])
    out = normalise_enrichment(v.wide.enrichments.withColumn("required_fields", required), longest=240)
    got = F.col("enriched_fields")
    return out.select("id", *[F.try_element_at(got, F.lit(k)).alias(k) for k in ("applicant_name", "address", "parcel_number", "email")],
                      F.size(got).cast("long").alias("n"), F.col("enriched_confidence").alias("confidence"), F.col("enriched_notes").alias("notes"))


@catalog.add("ocr_flatten", """
    SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || p_brand WHEN 3 THEN p_type END AS ocr_text,
      CASE p_partkey % 4 WHEN 0 THEN 0.625 WHEN 1 THEN 0.92 WHEN 3 THEN 0.75 END::DOUBLE AS ocr_confidence FROM part""")
def _(v):
    return flatten_ocr(v.ocr_replies).select("id", "ocr_text", "ocr_confidence")


@catalog.add("reply_precedence", sql(f"""
    SELECT id, CASE WHEN rid IS NULL THEN 'rules' ELSE 'reply' END AS classified_by, doc_type, department, urgency, confidence, requires_review FROM (
    {judged(f'''(SELECT * REPLACE (coalesce(r_type, doc_type) AS doc_type, coalesce(r_conf, cc) AS cc),
        coalesce(r_dept, {case_by_type(2, "'General Intake'")}) AS department,
        CASE WHEN rid IS NOT NULL THEN r_urgency WHEN {URGENT} THEN 'high' ELSE 'normal' END AS urgency
      FROM classified LEFT JOIN {_REPLY_SQL} ON rid = id)''')})"""))
def _(v):
    return process_documents(v.wide.intake_docs, RULES, v.as_of, replies=v.wide.replies).select(
        "id", "classified_by", "doc_type", "department", "urgency", "confidence", "requires_review")


_FILLED = """(SELECT * REPLACE (
    CASE WHEN id % 4 = 0 AND was <> '' THEN coalesce(applicant_name, 'Jane ' || id) ELSE applicant_name END AS applicant_name,
    CASE WHEN id % 4 = 0 AND was <> '' THEN coalesce(email, 'j@x.org') ELSE email END AS email,
    CASE WHEN id % 4 = 1 AND was <> '' THEN coalesce(address, rtrim(substr(repeat('12 Long Road ', 30), 1, 240))) ELSE address END AS address,
    CASE WHEN id % 4 = 1 AND was <> '' AND doc_type IN ('building_permit', 'zoning_variance') THEN coalesce(parcel_number, 'P' || id)
      ELSE parcel_number END AS parcel_number),
    array_to_string(list_filter([CASE WHEN id % 4 = 1 AND was <> '' AND address IS NULL THEN 'address' END,
      CASE WHEN id % 4 = 0 AND was <> '' AND applicant_name IS NULL THEN 'applicant_name' END,
      CASE WHEN id % 4 = 0 AND was <> '' AND email IS NULL THEN 'email' END,
      CASE WHEN id % 4 = 1 AND was <> '' AND doc_type IN ('building_permit', 'zoning_variance') AND parcel_number IS NULL THEN 'parcel_number' END],
      lambda n: n IS NOT NULL), ',') AS filled_fields
  FROM (SELECT * EXCLUDE (missing, missing_fields, validation_errors, n_errors, score, confidence, requires_review, sla_days),
    missing_fields AS was FROM (JUDGED)))""".replace("JUDGED", judged("classified"))


@catalog.add("enrichment_merge", sql(f"""SELECT id, applicant_name, address, parcel_number, email, missing_fields, filled_fields, confidence, requires_review
    FROM ({judged(_FILLED)})"""))
def _(v):
    out = process_documents(v.wide.intake_docs, RULES, v.as_of, enrichments=v.wide.enrichments, longest=240)
    got = F.col("extracted_fields")
    return out.select("id", *[F.try_element_at(got, F.lit(k)).alias(k) for k in ("applicant_name", "address", "parcel_number", "email")],
                      joined("missing_fields").alias("missing_fields"), joined("filled_fields").alias("filled_fields"), "confidence", "requires_review")


@catalog.add("stored_rule_order", """SELECT doc_type, (row_number() OVER (ORDER BY doc_type) - 1)::INT AS rule_order FROM (
    SELECT p_type || '-' || p_partkey AS doc_type FROM part UNION ALL SELECT 'other')""")
def _(v):
    p = v.table("part")
    raw = p.select(F.concat("p_type", F.lit("-"), F.col("p_partkey").cast("string")).alias("doc_type"), F.lit(0).alias("rule_order"), F.array("p_name").alias("keywords"),
                   F.col("p_brand").alias("department"), F.array("p_name").alias("required_fields"), F.col("p_size").alias("sla_days"))
    return normalize_rules(raw, alphabetical=True).select("doc_type", "rule_order")


@catalog.add("failure_isolation", sql("""SELECT id, CASE WHEN id % 10 = 3 THEN NULL ELSE doc_type END AS doc_type,
    CASE WHEN id % 10 = 3 THEN 'failed' WHEN requires_review THEN 'needs_review' ELSE 'routed' END AS status,
    requires_review OR id % 10 = 3 AS requires_review, CASE WHEN id % 10 = 3 THEN 'pipeline_failed' ELSE 'pipeline_processed' END AS action,
    CASE WHEN id % 10 = 3 THEN 'unreadable' ELSE 'doc_type=' || doc_type || ' confidence=' || confidence::VARCHAR || ' requires_review='
      || CASE WHEN requires_review THEN 'True' ELSE 'False' END || ' threshold=0.82' END AS details FROM processed"""))
def _(v):
    docs = v.wide.intake_docs.withColumn("extraction_error", F.when(F.col("id") % 10 == 3, "unreadable"))
    done = process_documents(docs, RULES, v.as_of)
    log = processing_audit(done, "system", v.as_of).select(F.col("document_id").alias("id"), "action", "details")
    return done.select("id", "doc_type", "status", "requires_review").join(log, "id")


@catalog.add("review_notifications", sql("""SELECT id AS document_id, 'Review needed: ' || filename AS title,
    'Type: ' || doc_type || ', Confidence: ' || confidence::VARCHAR AS message FROM processed WHERE requires_review"""))
def _(v):
    return review_notifications(processed(v), v.as_of).select("document_id", "title", "message")


@catalog.add("reprocess", sql("""SELECT l.id, CASE WHEN c THEN p.doc_type ELSE l.doc_type END AS doc_type,
    CASE WHEN NOT c THEN l.status WHEN p.requires_review THEN 'needs_review' ELSE 'routed' END AS status,
    CASE WHEN c THEN p.confidence ELSE l.confidence END AS confidence,
    CASE WHEN c THEN p.created_at + to_days(p.sla_days) ELSE l.due_date END AS due_date,
    CASE WHEN c THEN TIMESTAMP '1998-07-01' ELSE l.updated_at END AS updated_at
    FROM (SELECT *, status = 'failed' AS c FROM doc_ledger) l JOIN processed p ON p.id = l.id"""))
def _(v):
    chosen = v.doc_ledger.filter("status = 'failed'").select("id")
    out = reprocess(v.doc_ledger, v.wide.intake_docs.select("id", "text"), chosen, RULES, v.as_of)
    return out.select("id", "doc_type", "status", "confidence", "due_date", "updated_at")


@catalog.add("reupload", sql(f"""SELECT l.id, CASE WHEN l.id % 50 = 7 THEN 'again_' || l.id || '.txt' ELSE l.filename END AS filename,
    CASE WHEN l.id % 50 = 7 THEN 'complaint' ELSE l.doc_type END AS doc_type,
    CASE WHEN l.id % 50 = 7 THEN 'needs_review' ELSE l.status END AS status, l.created_at,
    CASE WHEN l.id % 50 = 7 THEN TIMESTAMP '1998-07-01' ELSE l.updated_at END AS updated_at FROM doc_ledger l"""))
def _(v):
    text = F.concat(F.lit("noise complaint report number "), F.col("o_orderkey").cast("string"))
    uploads = v.table("orders").filter("o_orderkey % 50 = 7").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("again_"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"), text.alias("text"))
    return reupload(v.doc_ledger, uploads, RULES, v.as_of).select("id", "filename", "doc_type", "status", "created_at", "updated_at")


@catalog.add("reply_sweep", sql(f"""
    SELECT count(*) AS processed_count, count_if(NOT requires_review)::BIGINT AS auto_cleared_count, count_if(requires_review)::BIGINT AS still_manual_count FROM (
    {judged(f'''(SELECT * REPLACE (coalesce(r_type, doc_type) AS doc_type, coalesce(r_conf, cc) AS cc)
      FROM classified LEFT JOIN {_REPLY_SQL} ON rid = id WHERE id IN (SELECT id FROM (SELECT id FROM doc_ledger WHERE status IN
        ('needs_review', 'assigned', 'acknowledged', 'failed') ORDER BY CASE status WHEN 'needs_review' THEN 1 WHEN 'assigned' THEN 2
        WHEN 'acknowledged' THEN 3 ELSE 4 END, updated_at DESC, id LIMIT 500)))''')})"""))
def _(v):
    return reply_sweep(v.doc_ledger, v.wide.intake_docs.select("id", "text"), v.wide.replies, RULES, v.as_of, 500, include_failed=True)


@catalog.add("due_dates", sql(f"""SELECT id, created_at + to_days({SLA_CASE}) AS due_date FROM
    (SELECT id, doc_type, CASE WHEN id % 20 = 0 THEN TIMESTAMP '1998-07-01' ELSE created_at END AS created_at FROM doc_ledger)"""))
def _(v):
    from clerkwise.functions.dates import due_date

    created = F.when(F.col("id") % 20 != 0, F.col("created_at"))
    sla = lookup(RULES, "doc_type", "sla_days")
    return v.doc_ledger.select("id", due_date(created, sla, v.as_of).alias("due_date"))


@catalog.add("receipt_amounts", sql("SELECT id, '$' || printf('%.2f', amount_cents / 100.0::DOUBLE) AS amount FROM payments"))
def _(v):
    return v.payments.select("id", money(F.col("amount_cents")).alias("amount"))


@catalog.add("text_decode", r"""
    SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN '' WHEN 5 THEN '' WHEN 1 THEN regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') ELSE text END AS text,
      ['native_text', 'native_text', 'json_text', 'content_type_text', 'ocr_placeholder', 'pdf_unavailable'][doc_id % 6 + 1] AS method,
      CASE WHEN doc_id % 6 IN (4, 5) OR text = '' THEN [0.1, 0.1, 0.2, 0.2, 0.2, 0.25][doc_id % 6 + 1]
        ELSE [0.99, 0.99, 0.95, 0.9][doc_id % 6 + 1] END::DOUBLE AS extraction_confidence FROM documents""")
def _(v):
    from clerkwise.plans.views import pick as choose

    kind = F.col("doc_id") % 6
    files = v.table("documents").select(
        "doc_id", choose(("a.TXT", "b.md", "c.json", "d.log", "e.bin", "f.pdf"), kind).alias("filename"),
        F.when(kind == 3, "text/x-log").otherwise("application/octet-stream").alias("content_type"),
        F.when(kind == 1, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return extract_text(files).select("doc_id", "text", "method", "extraction_confidence")


# Archives that are held as Python objects at a time.
ARCHIVES_AT_ONCE = 500


def _as_docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word documents made of the rows, to have some to read."""
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for whole in batches:
        for start in range(0, whole.num_rows, ARCHIVES_AT_ONCE):
            batch = whole.slice(start, ARCHIVES_AT_ONCE)
            contents = []
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
                lines = "".join(f"<w:p><w:r><w:t>{escape(role)}</w:t></w:r><w:r><w:t> {escape(t)} </w:t></w:r></w:p>" for t in text.split("\n"))
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as archive:
                    archive.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{lines}<w:p></w:p></w:body></w:document>')
                contents.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], pa.array(contents, pa.binary())], ["conv_id", "turn", "content"])


@catalog.add("broken_archives", """
    SELECT conv_id, turn, turn % 5 = 4 AS failed, CASE WHEN turn % 5 = 4 THEN 'pipeline_failed' ELSE 'pipeline_processed' END AS action,
      turn % 5 = 4 AS has_error FROM conversations""")
def _(v):
    """Every fifth archive is cut off: its row fails with a reason, the others go on."""
    made = v.table("conversations").select("conv_id", "turn", "role", "text").mapInArrow(_as_docx, "conv_id long, turn long, content binary")
    broken = F.when(F.col("turn") % 5 == 4, F.encode(F.lit("not an archive"), "UTF-8")).otherwise(F.col("content"))
    files = made.select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"), F.lit("turn.docx").alias("filename"),
                        F.lit(None).cast("string").alias("content_type"), broken.alias("content"), F.lit("1998-01-01").cast("timestamp").alias("created_at"))
    done = process_documents(extract_text(files, errors=True), RULES, v.as_of)
    log = processing_audit(done, "system", v.as_of).select(F.col("document_id").alias("id"), "action")
    return done.select("conv_id", "turn", "id", (F.col("status") == "failed").alias("failed"),
                       F.col("extraction_error").isNotNull().alias("has_error")).join(log, "id").drop("id")


@catalog.add("docx_text", """
    SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE array_to_string(list_transform(string_split(text, chr(10)),
      lambda t: CASE WHEN trim(t) = '' THEN role ELSE role || ' ' || trim(t) END), chr(10)) END AS text,
      CASE WHEN turn % 5 = 4 THEN 'docx_unavailable' ELSE 'docx_xml' END AS method, CASE WHEN turn % 5 = 4 THEN 0.2 ELSE 0.9 END::DOUBLE AS extraction_confidence
    FROM conversations""")
def _(v):
    made = v.table("conversations").select("conv_id", "turn", "role", "text").mapInArrow(_as_docx, "conv_id long, turn long, content binary")
    broken = F.when(F.col("turn") % 5 == 4, F.encode(F.lit("not a zip"), "UTF-8")).otherwise(F.col("content"))
    files = made.select("conv_id", "turn", F.lit("turn.docx").alias("filename"), F.lit(None).cast("string").alias("content_type"), broken.alias("content"))
    return extract_text(files).select("conv_id", "turn", "text", "method", "extraction_confidence")


def _part_rules(v: Views):
    """A rule for each part: its name and two syllables made from its number. Every fortieth has no keyword, and one is the fallback."""
    key = F.col("p_partkey")

    def letters(n: Column) -> Column:
        return F.concat(*[F.chr(F.lit(97) + F.floor(n / 26 ** k) % 26) for k in range(3)])

    words = F.when(key % 40 != 7, F.array(F.lower("p_name"), letters(key), letters(key * 7 + 3))).otherwise(F.array().cast("array<string>"))
    rules = v.table("part").select(
        F.concat(F.lit("part-"), key.cast("string")).alias("doc_type"), (key % 50).cast("int").alias("rule_order"), words.alias("keywords"),
        F.col("p_brand").alias("department"), F.array(F.lit("date")).alias("required_fields"), F.col("p_size").cast("int").alias("sla_days"))
    other = v.spark.range(1).select(F.lit("other").alias("doc_type"), F.lit(2**31 - 1).alias("rule_order"), F.array().cast("array<string>").alias("keywords"),
                                    F.lit("Desk").alias("department"), F.array(F.lit("date")).alias("required_fields"), F.lit(3).alias("sla_days"))
    return rules.unionByName(other)


def _letters(n: str) -> str:
    return " || ".join(f"chr((97 + ({n}) // {26 ** k} % 26)::INT)" for k in range(3))


@catalog.add("documents_by_part_rules", f"""
    WITH rules AS (SELECT 'part-' || p_partkey AS doc_type, p_partkey % 50 AS place, [lower(p_name), {_letters('p_partkey')}, {_letters('p_partkey * 7 + 3')}] AS words,
        p_brand AS department FROM part WHERE p_partkey % 40 <> 7),
    hits AS (SELECT doc_id, r.doc_type, r.place, r.department, list_filter(r.words, lambda w: contains(d.low, w)) AS matched
      FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) d, rules r WHERE contains(d.low, r.words[1]) OR contains(d.low, r.words[2]) OR contains(d.low, r.words[3])),
    best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(matched) DESC, place, doc_type) = 1)
    SELECT d.doc_id, coalesce(b.doc_type, 'other') AS doc_type, coalesce(b.department, 'Desk') AS department,
      round(CASE coalesce(len(b.matched), 0) WHEN 0 THEN 0.45 WHEN 1 THEN 0.65::DOUBLE + (1.0::DOUBLE / 3) * 0.08 WHEN 2 THEN 0.78::DOUBLE + (2.0::DOUBLE / 3) * 0.08
        ELSE 0.86 END, 4) AS confidence, coalesce(array_to_string(b.matched, ','), '') AS matched_keywords
    FROM documents d LEFT JOIN best b USING (doc_id)""")
def _(v):
    """Every keyword of all part rules searched in the whole texts, the rules in blocks of 64 KB."""
    rules = _part_rules(v)
    found = with_attributes(classify_by_table(v.wide.table("documents"), rules, block_bytes=1 << 16), rules, ["department"])
    return found.select("doc_id", "doc_type", F.col("__rule_department").alias("department"), F.col("classification_confidence").alias("confidence"),
                        joined("matched_keywords").alias("matched_keywords"))
