"""Queries over changes, imports, workflows, mail and sources."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.functions.predicates import visible_to
from clerkwise.operators import changes, imports, lifecycle, mail, sinks, sla, workflows
from clerkwise.operators.rules import literal_rules
from clerkwise.plans.catalog import catalog, joined
from clerkwise.plans.duck import AS_OF, EDGES, EVENTS_AS_OF, case_by_type, pick, sql
from clerkwise.plans.views import STATUSES, TYPES, Views
from clerkwise.plans.views import pick as choose
from clerkwise.session import shared_folder, spread
from clerkwise.sources import connectors, snapshots
from clerkwise.sources.tables import copy_tables, reconcile
from clerkwise.streaming.ingest import retention_run

RULES = literal_rules()
BLANK = "(assigned_to IS NULL OR trim(assigned_to) = '')"
STATUS_TO = ("acknowledged", "approved", "archived", "completed", "in_progress", "needs_review")


# --- status changes -------------------------------------------------------

def _status_requests(v: Views):
    e = v.table("events")
    return e.select((F.col("event_id") * 2).alias("document_id"), choose(STATUS_TO, F.col("event_id") % 6).alias("to_status"),
                    F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string")))
                    .when(F.col("event_id") % 3 == 1, "").alias("notes"))


_MOVES = f"""(SELECT r.*, d.id IS NOT NULL AS known, d.status AS current, e.target IS NOT NULL AS ok FROM (
    SELECT event_id * 2 AS document_id, {pick(STATUS_TO, 'event_id % 6')} AS to_status, CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id END AS notes FROM events) r
    LEFT JOIN doc_ledger d ON d.id = r.document_id LEFT JOIN {EDGES} ON e.source = d.status AND e.target = r.to_status)"""


@catalog.add("transition_apply", sql(f"""SELECT document_id, current AS from_status, to_status, ok AS applied, CASE WHEN ok THEN to_status ELSE current END AS status,
    CASE WHEN ok THEN notes END AS reviewer_notes, CASE WHEN NOT known THEN 'not found' WHEN NOT ok THEN 'Cannot transition from ''' || current || ''' to ''' || to_status || '''' END AS error
    FROM {_MOVES}"""))
def _(v):
    return lifecycle.apply_transitions(v.doc_ledger, _status_requests(v))


@catalog.add("transition_audit", sql(f"""SELECT document_id, 'status_transition' AS action, 'clerk' AS actor, 'from=' || current || ' to=' || to_status AS details,
    {AS_OF} AS created_at FROM {_MOVES} WHERE ok"""))
def _(v):
    return lifecycle.transition_audit(lifecycle.apply_transitions(v.doc_ledger, _status_requests(v)), "clerk", v.as_of)


@catalog.add("transition_notifications", sql(f"""SELECT m.document_id, d.filename || ': ' || m.current || ' → ' || m.to_status AS title, d.workspace_id
    FROM {_MOVES} m JOIN doc_ledger d ON d.id = m.document_id WHERE m.ok"""))
def _(v):
    moved = lifecycle.apply_transitions(v.doc_ledger, _status_requests(v))
    return lifecycle.transition_notifications(moved, v.doc_ledger, v.as_of).select("document_id", "title", "workspace_id")


def _assign_requests(v: Views):
    return v.table("events").select((F.col("event_id") * 2).alias("document_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"))


@catalog.add("assign_apply", sql("""SELECT e.event_id * 2 AS document_id, 'u' || e.user_id AS assigned_to,
    CASE WHEN d.status IN ('needs_review', 'acknowledged') THEN 'assigned' ELSE d.status END AS status FROM events e JOIN doc_ledger d ON d.id = e.event_id * 2"""))
def _(v):
    return lifecycle.assign(v.doc_ledger, _assign_requests(v)).select("document_id", "assigned_to", "status")


@catalog.add("assignment_log", sql("""SELECT e.event_id * 2 AS document_id, 'assigned_to=u' || e.user_id AS details, 'Document assigned to you: ' || d.filename AS title,
    'Type: ' || coalesce(d.doc_type, 'None') AS message FROM events e JOIN doc_ledger d ON d.id = e.event_id * 2"""))
def _(v):
    changed = lifecycle.assign(v.doc_ledger, _assign_requests(v))
    log = lifecycle.assignment_audit(changed, "clerk", v.as_of).select("document_id", "details")
    return log.join(lifecycle.assignment_notifications(changed, v.as_of).select("document_id", "title", "message"), "document_id")


@catalog.add("auto_assign", sql(f"""SELECT id AS document_id, 'triage_queue' AS assigned_to, status AS from_status, 'assigned' AS status FROM doc_ledger
    WHERE status IN ('needs_review', 'acknowledged') AND {BLANK} ORDER BY due_date ASC NULLS LAST, updated_at DESC, id LIMIT 1000"""))
def _(v):
    return lifecycle.auto_assign(v.doc_ledger, limit=1000)


@catalog.add("auto_assign_notifications", sql(f"""SELECT id AS document_id, 'triage_queue' AS user_id, 'Document assigned: ' || filename AS title, workspace_id FROM doc_ledger
    WHERE status IN ('needs_review', 'acknowledged') AND {BLANK} ORDER BY due_date ASC NULLS LAST, updated_at DESC, id LIMIT 500"""))
def _(v):
    changed = lifecycle.auto_assign(v.doc_ledger, limit=500)
    return lifecycle.auto_assignment_notifications(changed, v.doc_ledger, v.as_of).select("document_id", "user_id", "title", "workspace_id")


@catalog.add("auto_assign_counts", sql(f"""SELECT least(n, 1000) AS assigned_count, greatest(n - 1000, 0) AS remaining_unassigned FROM (
    SELECT count(*) AS n FROM doc_ledger WHERE status IN ('needs_review', 'acknowledged') AND {BLANK})"""))
def _(v):
    return lifecycle.auto_assign_counts(v.doc_ledger, 1000)


@catalog.add("review_merge", sql(f"""
    SELECT document_id, CASE WHEN NOT approve THEN 'needs_review' WHEN new_type <> '' OR k % 3 = 0 THEN 'corrected' ELSE 'approved' END AS status,
      kind AS doc_type, CASE WHEN NOT approve THEN department WHEN k % 7 = 0 THEN 'Desk 7' ELSE routed END AS department,
      CASE WHEN approve AND k % 3 = 0 THEN 'Fixed ' || k ELSE applicant_name END AS applicant_name, email, CASE WHEN approve THEN '' ELSE missing END AS missing_fields,
      NOT approve AS requires_review, 'n' || k AS reviewer_notes
    FROM (SELECT *, {case_by_type(2, "'General Intake'").replace('CASE doc_type', 'CASE kind')} AS routed FROM (
      SELECT e.event_id AS k, e.event_id * 2 AS document_id, e.event_id % 5 <> 0 AS approve, CASE WHEN e.event_id % 4 = 1 THEN 'complaint' ELSE '' END AS new_type,
        CASE WHEN e.event_id % 5 <> 0 AND e.event_id % 4 = 1 THEN 'complaint' ELSE d.doc_type END AS kind, d.* EXCLUDE (id, doc_type)
      FROM events e JOIN doc_ledger d ON d.id = e.event_id * 2))"""))
def _(v):
    out = lifecycle.review(v.doc_ledger, _reviews(v), RULES)
    got = F.col("extracted_fields")
    return out.select("document_id", "status", "doc_type", "department", F.try_element_at(got, F.lit("applicant_name")).alias("applicant_name"),
                      F.try_element_at(got, F.lit("email")).alias("email"), joined("missing_fields").alias("missing_fields"), "requires_review", "reviewer_notes")


def _reviews(v: Views):
    k = F.col("event_id")
    return v.table("events").select(
        (k * 2).alias("document_id"), (k % 5 != 0).alias("approve"), F.concat(F.lit("n"), k.cast("string")).alias("notes"),
        F.when(k % 4 == 1, "complaint").alias("corrected_doc_type"), F.when(k % 7 == 0, "Desk 7").alias("corrected_department"),
        F.when(k % 3 == 0, F.create_map(F.lit("applicant_name"), F.concat(F.lit("Fixed "), k.cast("string")))).alias("corrected_fields"))


@catalog.add("review_audit", """SELECT event_id * 2 AS document_id, 'reviewed' AS action, 'approve=' || CASE WHEN event_id % 5 <> 0 THEN 'True' ELSE 'False' END
    || ' corrected_doc_type=' || CASE WHEN event_id % 4 = 1 THEN 'complaint' ELSE 'None' END
    || ' allowed_types=benefits_application,building_permit,business_license,complaint,court_filing,foi_request,other,zoning_variance' AS details FROM events""")
def _(v):
    return lifecycle.review_audit(_reviews(v), RULES, "clerk", v.as_of).select("document_id", "action", "details")


_ACTIONS = ("approve", "assign", "transition", "shred")


def _bulk_requests(v: Views):
    k = F.col("event_id")
    return v.table("events").select(
        (k * 2).alias("document_id"), choose(_ACTIONS, k % 4).alias("action"), F.when(k % 8 != 1, F.concat(F.lit("u"), (k % 9).cast("string"))).alias("user_id"),
        F.when(k % 8 == 2, "approved").when(k % 16 != 6, "archived").alias("to_status"))


_BULK = f"""(SELECT *, CASE WHEN NOT known THEN 'not found' WHEN action = 'shred' THEN 'unknown action ''shred'''
      WHEN action = 'assign' AND user_id IS NULL THEN 'user_id required for assign' WHEN action = 'transition' AND to_status IS NULL THEN 'status required for transition'
      WHEN action = 'transition' AND NOT ok THEN 'invalid transition ' || current || ' → ' || to_status END AS why
    FROM (SELECT r.*, d.id IS NOT NULL AS known, d.status AS current, d.assigned_to AS owner, d.requires_review AS flag, e.target IS NOT NULL AS ok FROM (
      SELECT event_id * 2 AS document_id, {pick(_ACTIONS, 'event_id % 4')} AS action, CASE WHEN event_id % 8 <> 1 THEN 'u' || (event_id % 9) END AS user_id,
        CASE WHEN event_id % 8 = 2 THEN 'approved' WHEN event_id % 16 <> 6 THEN 'archived' END AS to_status FROM events) r
      LEFT JOIN doc_ledger d ON d.id = r.document_id LEFT JOIN {EDGES} ON e.source = d.status AND e.target = r.to_status))"""


@catalog.add("bulk_outcome", sql(f"""SELECT document_id, action, CASE WHEN why IS NULL THEN 'ok' ELSE 'error' END AS outcome, document_id || ': ' || why AS error,
    CASE WHEN why IS NOT NULL THEN current WHEN action = 'approve' THEN 'approved' WHEN action = 'transition' THEN to_status
      WHEN current IN ('needs_review', 'acknowledged') THEN 'assigned' ELSE current END AS status,
    CASE WHEN why IS NULL AND action = 'assign' THEN user_id ELSE owner END AS assigned_to,
    CASE WHEN why IS NULL AND action = 'approve' THEN false ELSE flag END AS requires_review FROM {_BULK}"""))
def _(v):
    return lifecycle.bulk(v.doc_ledger, _bulk_requests(v))


@catalog.add("bulk_counts", sql(f"SELECT count_if(why IS NULL)::BIGINT AS success_count, count_if(why IS NOT NULL)::BIGINT AS error_count FROM {_BULK}"))
def _(v):
    return lifecycle.bulk_counts(lifecycle.bulk(v.doc_ledger, _bulk_requests(v)))


@catalog.add("mark_all_read", sql(f"""SELECT id, is_read OR hit AS is_read, CASE WHEN hit THEN {EVENTS_AS_OF} ELSE read_at END AS read_at, hit AS changed FROM (
    SELECT *, (user_id = 'u3' OR user_id IS NULL) AND NOT is_read AS hit0, coalesce((user_id = 'u3' OR user_id IS NULL) AND NOT is_read, false) AS hit FROM notifications)"""))
def _(v):
    return lifecycle.mark_read(v.notifications, visible_to("u3"), v.events_as_of).select("id", "is_read", "read_at", "changed")


@catalog.add("mark_read_ids", sql(f"""SELECT id, is_read OR hit AS is_read, CASE WHEN hit THEN {EVENTS_AS_OF} ELSE read_at END AS read_at, hit AS changed FROM (
    SELECT *, coalesce((user_id = 'u3' OR user_id IS NULL) AND id IN (SELECT event_id FROM events WHERE event_id % 3 = 0), false) AS hit FROM notifications)"""))
def _(v):
    ids = v.table("events").filter("event_id % 3 = 0").select(F.col("event_id").alias("id"))
    return lifecycle.mark_read(v.notifications, visible_to("u3"), v.events_as_of, ids).select("id", "is_read", "read_at", "changed")


@catalog.add("backfill_tables", sql("""SELECT 'documents' AS "table", CASE WHEN id % 2 = 0 THEN 'ws-default' ELSE workspace_id END AS workspace_id, count(*) AS n FROM doc_ledger GROUP BY ALL
    UNION ALL SELECT 'audit_events', coalesce(workspace_id, 'ws-default'), count(*) FROM audit_events GROUP BY ALL
    UNION ALL SELECT 'notifications', coalesce(workspace_id, 'ws-default'), count(*) FROM notifications GROUP BY ALL
    UNION ALL SELECT 'users', NULL, count(*) FROM users"""))
def _(v):
    ledger = v.doc_ledger.withColumn("workspace_id", F.when(F.col("id") % 2 != 0, F.col("workspace_id")))
    tables = {"documents": ledger, "audit_events": v.audit_events, "notifications": v.notifications,
              "users": v.users.withColumn("workspace_id", F.lit(None).cast("string"))}
    done = changes.backfill_workspace(tables, v.workspaces.filter("id = 'no such workspace'"), "ws-default")
    counts = [df.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "workspace_id", "n") for name, df in done.items()]
    return reduce(DataFrame.unionByName, counts)


@catalog.add("retention_tables", sql("""SELECT 'audit_events' AS "table", count(*) AS kept FROM audit_events WHERE created_at >= TIMESTAMP '2031-01-14' - INTERVAL 2555 DAY
    UNION ALL SELECT 'notifications', count(*) FROM notifications WHERE created_at >= TIMESTAMP '2031-01-14' - INTERVAL 730 DAY"""))
def _(v):
    done = retention_run({"audit_events": v.audit_events, "notifications": v.notifications}, instant("2031-01-14 00:00:00"))
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("kept")) for name, df in done.items()])


@catalog.add("job_retry", sql(f"""SELECT id, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status,
    CASE WHEN attempts >= max_attempts THEN {EVENTS_AS_OF} END AS finished_at, CASE WHEN attempts >= max_attempts THEN started_at END AS started_at
    FROM jobs WHERE status = 'failed'"""))
def _(v):
    return lifecycle.retry_jobs(v.jobs.filter("status = 'failed'"), v.events_as_of).select("id", "status", "finished_at", "started_at")


@catalog.add("bulk_audit", sql(f"""SELECT document_id, CASE action WHEN 'approve' THEN 'bulk_approved' WHEN 'assign' THEN 'bulk_assigned' ELSE 'bulk_transition' END AS action,
    CASE action WHEN 'assign' THEN 'assigned_to=' || user_id WHEN 'transition' THEN 'to=' || to_status END AS details FROM {_BULK} WHERE why IS NULL"""))
def _(v):
    return lifecycle.bulk_audit(lifecycle.bulk(v.doc_ledger, _bulk_requests(v)), "clerk", v.as_of).select("document_id", "action", "details")


@catalog.add("bulk_errors", sql(f"SELECT document_id, action, document_id || ': ' || why AS error FROM {_BULK} WHERE why IS NOT NULL ORDER BY document_id, action, error LIMIT 50"))
def _(v):
    return lifecycle.bulk_errors(lifecycle.bulk(v.doc_ledger, _bulk_requests(v)), 50)


# --- table changes --------------------------------------------------------

def _status_changes(v: Views):
    rows = v.table("events").select(F.expr("event_id div 2 * 3").alias("id"), F.col("event_id").alias("seq"),
                                    choose(STATUSES, F.col("event_id") % 10).alias("status"))
    return changes.last_per_key(rows, ["id"], ["seq"])


_LAST = f"""(SELECT event_id // 2 * 3 AS id, max(event_id) AS seq, arg_max({pick(STATUSES, 'event_id % 10')}, event_id) AS status FROM events GROUP BY ALL)"""


@catalog.add("update_by_key", sql(f"""SELECT d.id, coalesce(c.status, d.status) AS status, CASE WHEN c.id IS NULL THEN d.updated_at ELSE {AS_OF} END AS updated_at
    FROM doc_ledger d LEFT JOIN {_LAST} c ON c.id = d.id"""))
def _(v):
    base = v.doc_ledger.select("id", "status", "updated_at")
    return changes.update_by_key(base, _status_changes(v), "id", ["status"], v.as_of)


@catalog.add("insert_ignore", sql("""
    SELECT connector_type, external_id, min(position) AS position FROM (SELECT connector_type, external_id, position FROM listing
      WHERE (connector_type, external_id) NOT IN (SELECT (connector_type, external_id) FROM sync_ledger)) GROUP BY ALL
    UNION ALL SELECT connector_type, external_id, NULL FROM sync_ledger"""))
def _(v):
    return changes.insert_ignore(v.sync_ledger, v.listing.select("connector_type", "external_id", "position"),
                                 ["connector_type", "external_id"], ["position"])


@catalog.add("upsert_snapshot", sql(f"""
    SELECT d.id, d.workspace_id, d.status FROM doc_ledger d WHERE d.id NOT IN (SELECT id + 500 FROM {_LAST})
    UNION ALL SELECT c.id + 500, coalesce(d.workspace_id, 'new'), c.status FROM {_LAST} c LEFT JOIN doc_ledger d ON d.id = c.id + 500"""))
def _(v):
    base = v.doc_ledger.select("id", "workspace_id", "status")
    new = v.table("events").select((F.expr("event_id div 2 * 3") + 500).alias("id"), F.lit("new").alias("workspace_id"),
                                   choose(STATUSES, F.col("event_id") % 10).alias("status"), F.col("event_id").alias("seq"))
    return changes.upsert(base, new, ["id"], ["seq"], keep=["workspace_id"])


@catalog.add("delete_by_key", sql("SELECT id, status FROM doc_ledger WHERE id NOT IN (SELECT event_id * 2 FROM events WHERE event_type = 'error')"))
def _(v):
    gone = v.table("events").filter("event_type = 'error'").select((F.col("event_id") * 2).alias("id"))
    return changes.delete_keys(v.doc_ledger.select("id", "status"), gone, ["id"])


def _bucket_sql(key: str, buckets: int = 64) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT % {buckets})::INT"


def _nation_changes(v: Views):
    """A few documents: one for each nation."""
    return v.table("nation").select((F.col("n_nationkey") * 4).cast("long").alias("id"), F.lit("archived").alias("status"))


def _snapshot(v: Views) -> str:
    path = f"{shared_folder(v.spark)}/snapshot-{uuid4().hex}"
    snapshots.write_snapshot(v.doc_ledger.select(F.col("id").cast("long").alias("id"), "status", "updated_at"), path, "id")
    return path


@catalog.add("snapshot_update", sql(f"""SELECT {_bucket_sql('d.id')} AS bucket, 2 AS held, count(*) AS "rows" FROM doc_ledger d
    WHERE {_bucket_sql('d.id')} IN (SELECT {_bucket_sql('n_nationkey * 4')} FROM nation) GROUP BY ALL"""))
def _(v):
    """Which buckets of a snapshot an update of a few rows has written."""
    return snapshots.change_snapshot(v.spark, _snapshot(v), _nation_changes(v), lambda rows, new: changes.update_by_key(rows, new, "id", ["status"], v.as_of))


@catalog.add("snapshot_state", sql(f"""
    SELECT id, CASE WHEN id IN (SELECT n_nationkey * 4 FROM nation) THEN 'archived' ELSE status END AS status,
      CASE WHEN id IN (SELECT n_nationkey * 4 FROM nation) THEN {AS_OF} ELSE updated_at END AS updated_at
    FROM doc_ledger WHERE id NOT IN (SELECT s_suppkey * 3 FROM supplier) UNION ALL SELECT 100000000 + r_regionkey, 'ingested', {AS_OF} FROM region"""))
def _(v):
    """The rows after an update, an upsert and a delete, each of which rewrites some buckets only."""
    path = _snapshot(v)
    new = v.table("region").select((F.col("r_regionkey") + 100_000_000).cast("long").alias("id"), F.lit("ingested").alias("status"), v.as_of.alias("updated_at"))
    gone = v.table("supplier").select((F.col("s_suppkey") * 3).cast("long").alias("id"))
    snapshots.change_snapshot(v.spark, path, _nation_changes(v), lambda rows, some: changes.update_by_key(rows, some, "id", ["status"], v.as_of))
    snapshots.change_snapshot(v.spark, path, new, lambda rows, some: changes.upsert(rows, some, ["id"], ["updated_at"]))
    snapshots.change_snapshot(v.spark, path, gone, lambda rows, some: changes.delete_keys(rows, some, ["id"]))
    return snapshots.read_snapshot(v.spark, path)


@catalog.add("snapshot_join", sql("""SELECT d.id, d.status, e.event_type FROM doc_ledger d JOIN events e ON e.event_id = d.id"""))
def _(v):
    """Two snapshots bucketed by the same key meet without a shuffle."""
    name = uuid4().hex
    place = f"{shared_folder(v.spark)}/bucketed-{name}"
    left = snapshots.bucketed_table(v.doc_ledger.select(F.col("id").cast("long").alias("id"), "status"), f"ledger_{name}", f"{place}/ledger", "id", 8)
    right = snapshots.bucketed_table(v.table("events").select(F.col("event_id").cast("long").alias("id"), "event_type"), f"events_{name}", f"{place}/events", "id", 8)
    return left.hint("merge").join(right, "id")


@catalog.add("retention_purge", sql("SELECT id, action, created_at FROM audit_events WHERE created_at >= TIMESTAMP '2031-01-14' - INTERVAL 2555 DAY"))
def _(v):
    cutoff = changes.retention_cutoff("audit_events", instant("2031-01-14 00:00:00"))
    return changes.purge_before(v.audit_events, "created_at", cutoff).select("id", "action", "created_at")


@catalog.add("retention_counts", sql("""SELECT count_if(created_at < TIMESTAMP '2024-01-15')::BIGINT AS removed, count_if(created_at >= TIMESTAMP '2024-01-15')::BIGINT AS kept
    FROM notifications"""))
def _(v):
    return changes.purge_count(v.notifications, "created_at", instant("2024-01-15 00:00:00"))


@catalog.add("backfill_default", sql("SELECT id, coalesce(workspace_id, 'ws-default') AS workspace_id FROM audit_events"))
def _(v):
    return changes.backfill(v.audit_events, "workspace_id", F.lit("ws-default")).select("id", "workspace_id")


@catalog.add("bootstrap_members", sql("""SELECT 'ws-default' AS workspace_id, id AS user_id, CASE WHEN k = (SELECT arg_min(k, (created_at, id)) FROM users WHERE role = 'admin')
    THEN 'admin' ELSE 'member' END AS role FROM users"""))
def _(v):
    none = v.workspaces.filter("id = 'no such workspace'")
    return changes.bootstrap_workspace(v.users, none, "ws-default", v.as_of)[1].select("workspace_id", "user_id", "role")


@catalog.add("schema_evolution", sql("""SELECT id, name, 'a' AS origin, NULL AS owner_id FROM workspaces UNION ALL SELECT id, NULL, 'b', owner_id FROM workspaces"""))
def _(v):
    w = v.workspaces
    return changes.additive_union([w.select("id", "name", F.lit("a").alias("origin")), w.select("id", "owner_id", F.lit("b").alias("origin"))])


# --- imports --------------------------------------------------------------

@catalog.add("import_validate", sql("SELECT position, reject_reason FROM checked"))
def _(v):
    return imports.validate_files(v.listing).select("position", "reject_reason")


@catalog.add("import_dedup", sql("""SELECT connector_type, external_id, min(position) AS position FROM listing
    WHERE (connector_type, external_id) NOT IN (SELECT (connector_type, external_id) FROM sync_ledger) GROUP BY ALL"""))
def _(v):
    return imports.new_only(v.listing, v.sync_ledger, ["connector_type", "external_id"], ["position"]).select("connector_type", "external_id", "position")


_WHY = "filename || ': ' || CASE WHEN length = 0 THEN 'Empty file content.' ELSE 'Validation failed — ' || reject_reason END"


def _outcomes(v: Views):
    return imports.import_outcomes(v.listing, v.sync_ledger, ["connector_type", "external_id"], ["position"])


@catalog.add("import_outcomes", sql(f"SELECT position, outcome, CASE WHEN outcome = 'failed' THEN {_WHY} END AS error FROM outcomes"))
def _(v):
    return _outcomes(v).select("position", "outcome", "error")


@catalog.add("import_summary", sql("""SELECT count_if(outcome = 'imported')::BIGINT AS imported_count, count_if(outcome = 'skipped')::BIGINT AS skipped_count,
    count_if(outcome = 'failed')::BIGINT AS failed_count FROM outcomes"""))
def _(v):
    return imports.import_summary(_outcomes(v))


@catalog.add("import_errors", sql(f"SELECT position, {_WHY} AS error FROM outcomes WHERE outcome = 'failed' ORDER BY position LIMIT 50"))
def _(v):
    return imports.import_errors(_outcomes(v), ["position"], 50).select("position", "error")


@catalog.add("files_ingested", sql("SELECT count(*) AS files_ingested FROM checked WHERE reject_reason IS NULL"))
def _(v):
    return imports.files_ingested(imports.validate_files(v.listing).filter("reject_reason is null"))


@catalog.add("sync_log_rows", sql("""SELECT connector_type, external_id, sha256(connector_type || chr(1) || external_id) AS document_id, metadata_json FROM (
    SELECT connector_type, external_id, arg_min('{"position":"' || position || '"}', position) AS metadata_json FROM checked WHERE reject_reason IS NULL
      AND (connector_type, external_id) NOT IN (SELECT (connector_type, external_id) FROM sync_ledger) GROUP BY ALL)"""))
def _(v):
    good = imports.validate_files(v.listing).filter("reject_reason is null")
    fresh = imports.new_only(good, v.sync_ledger, ["connector_type", "external_id"], ["position"])
    fresh = fresh.withColumn("metadata", F.create_map(F.lit("position"), F.col("position").cast("string")))
    return imports.sync_log_rows(fresh, v.as_of).select("connector_type", "external_id", "document_id", "metadata_json")


@catalog.add("connector_audit", sql("""SELECT sha256(connector_type || chr(1) || external_id) AS document_id, 'ws1' AS workspace_id, 'connector_imported' AS action,
    'source=connector_' || connector_type || ' external_id=' || external_id AS details FROM outcomes WHERE outcome = 'imported'"""))
def _(v):
    fresh = _outcomes(v).filter("outcome = 'imported'")
    return imports.connector_audit(fresh, "ws1", "connector_import", v.as_of).select("document_id", "workspace_id", "action", "details")


@catalog.add("new_documents", sql("""SELECT sha256(position::VARCHAR) AS id, sha256(position::VARCHAR) || '_' || filename AS storage_path, 'connector_s3' AS source_channel,
    'ingested' AS status, 'normal' AS urgency, content_type FROM checked WHERE reject_reason IS NULL"""))
def _(v):
    good = imports.validate_files(v.listing).filter("reject_reason is null")
    return imports.new_documents(good, ["position"], "connector_s3", v.as_of).select(
        "id", "storage_path", "source_channel", "status", "urgency", "content_type")


@catalog.add("import_rows", """
    SELECT doc_id AS position, name AS filename, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE strlen(text) END::INT AS length,
      CASE WHEN bad IS NULL THEN 'imported' ELSE 'failed' END AS outcome, 'Row ' || doc_id || ': ' || bad AS error FROM (
      SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'Content value is empty.' WHEN strlen(text) = 0 THEN 'Content column is empty.'
        WHEN doc_id % 6 = 2 THEN 'File extension is not allowed. Allowed: csv, docm, docx, jpeg, jpg, json, md, pdf, png, tif, tiff, txt'
        WHEN doc_id % 10 = 3 THEN 'Unsupported content type.' END AS bad
      FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'db_document_' || doc_id || '.txt' WHEN 1 THEN 'in.md' WHEN 2 THEN 'x.zip' ELSE 'row' || doc_id || '.csv' END AS name FROM documents))""")
def _(v):
    k = F.col("doc_id")
    rows = v.table("documents").select(
        k.alias("position"), F.when(k % 6 == 0, "  ").when(k % 6 == 1, "/a/b/in.md").when(k % 6 == 2, "x.zip")
        .otherwise(F.concat(F.lit("row"), k.cast("string"), F.lit(".csv"))).alias("FileName"),
        F.when(k % 4 != 1, F.col("text")).alias("CONTENT"), F.when(k % 10 == 3, "audio/wav").alias("content_type"))
    return imports.import_rows(rows, "position").select("position", "filename", "length", "outcome", "error")


@catalog.add("content_coerce", """SELECT doc_id, strlen(text)::INT AS text_bytes, strlen(doc_id::VARCHAR)::INT AS number_bytes, sha256(text) AS digest,
    strlen('{"a": "' || lang || '", "b": null}')::INT AS object_bytes, strlen('["' || lang || '"]')::INT AS list_bytes FROM documents""")
def _(v):
    d = v.table("documents").withColumns({"obj": F.struct(F.col("lang").alias("a"), F.lit(None).cast("int").alias("b")), "arr": F.array("lang"), "bin": F.encode("text", "UTF-8")})
    kinds = {f.name: f.dataType for f in d.schema.fields}

    def size(name):
        return F.length(imports.coerce_content(F.col(name), kinds[name]))

    return d.select("doc_id", size("text").alias("text_bytes"), size("doc_id").alias("number_bytes"),
                    F.sha2(imports.coerce_content(F.col("bin"), kinds["bin"]), 256).alias("digest"),
                    size("obj").alias("object_bytes"), size("arr").alias("list_bytes"))


_STATEMENTS = ("select * from t where k = {k}", "  WITH a AS (select 1) select * from a -- {k}", "", "-- only {k}", "select 1; select {k}", "update t set a = {k}",
               "select drop_it from t{k}", "select 1 /* delete */ from t{k};", "select a from t; ", "with x as (select 1) delete from t{k}")
_REASONS = (None, None, "Query is required.", "Query is empty after removing SQL comments.", "Only one SELECT statement is allowed.",
            "Only SELECT queries are allowed for database imports.", None, None, None, "Query contains a disallowed keyword: 'delete'.")


@catalog.add("readonly_query_guard", "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if r is None else "'" + r.replace("'", "''") + "'") for i, r in enumerate(_REASONS)) + " END AS rejected_reason FROM orders")
def _(v):
    key = F.col("o_orderkey")
    query = F.replace(choose(_STATEMENTS, key % 10), F.lit("{k}"), key.cast("string"))
    return v.table("orders").select("o_orderkey", imports.guard_readonly(query).alias("rejected_reason"))


@catalog.add("table_reconcile", """SELECT 'documents' AS "table", (SELECT count(*) FROM documents) AS source_rows, (SELECT count(*) FROM labels) AS target_rows""")
def _(v):
    return reconcile("documents", v.table("documents"), v.table("labels"))


@catalog.add("table_copy", """SELECT 'documents' AS "table", count(*) AS source_rows, count(*) AS target_rows FROM documents
    UNION ALL SELECT 'users', count(*), count(*) FROM customer UNION ALL SELECT 'events', count(*), count(*) FROM events""")
def _(v):
    sources = {"documents": v.table("documents"), "users": v.table("customer"), "events": v.table("events")}
    return copy_tables(sources, f"{shared_folder(v.spark)}/copy-{uuid4().hex}")


# --- connector listings ---------------------------------------------------

_LISTED = ("external_id", "filename", "content_type", "download_url", "size_bytes")


def _listed(df, *meta: str):
    return df.select(*_LISTED, *[F.element_at("metadata", F.lit(m)).alias(m) for m in meta])


def _key_payload(v: Views, table: str, key: str, build):
    """One stored API reply per row of a table."""
    t = v.wide.table(table)
    return t.select(F.to_json(build(F.col(key), F.col(key).cast("string"))).alias("payload"))


@catalog.add("s3_listing", """SELECT 's3_bkt_' || key AS external_id, 'd' || doc_id || '.txt' AS filename, 'text/plain' AS content_type,
    'https://s3.example.com/bkt/' || replace(replace(key, ' ', '%20'), '#', '%23') AS download_url, n_chars AS size_bytes, 'bkt' AS bucket, key FROM (
    SELECT *, 'in/' || lang || '/# ' || doc_id % 3 || '/d' || doc_id || '.txt' AS key FROM documents) WHERE doc_id % 7 <> 0 AND lang = 'en'""")
def _(v):
    k = F.col("doc_id").cast("string")
    key = F.concat(F.lit("in/"), "lang", F.when(F.col("doc_id") % 7 == 0, F.lit("/")).otherwise(F.concat(F.lit("/# "), (F.col("doc_id") % 3).cast("string"), F.lit("/d"), k, F.lit(".txt"))))
    objects = v.table("documents").select(key.alias("key"), F.col("n_chars").alias("size"))
    return _listed(connectors.object_store(objects, "s3", "bkt", "https://s3.example.com/bkt", "in/en"), "bucket", "key")


@catalog.add("gcs_listing", """SELECT 'gcs_bkt_' || key AS external_id, 'd' || doc_id AS filename, lang AS content_type, 'https://gcs.example.com/storage/v1/b/bkt/o/' || replace(replace(key, ' ', '%20'), '/', '%2F') || '?alt=media' AS download_url,
    nullif(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END, 0) AS size_bytes, key AS object_name FROM (SELECT *, lang || ' x/d' || doc_id AS key FROM documents)""")
def _(v):
    objects = v.table("documents").select(F.concat("lang", F.lit(" x/d"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("content_type"),
                                          F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.col("n_chars").cast("string")).alias("size"))
    return _listed(connectors.object_store(objects, "gcs", "bkt", "https://gcs.example.com"), "object_name")


@catalog.add("servicenow_listing", """
    SELECT 'sn_att' || lpad(o_orderkey::VARCHAR, 10, '0') || a.n AS external_id, CASE WHEN a.n = 1 THEN 'f' || o_orderkey || '.pdf' ELSE 'attachment_att' || lpad((o_orderkey // 100000)::VARCHAR, 5, '0') END AS filename,
      'application/pdf' AS content_type, 'https://sn.example.com/api/now/attachment/att' || lpad(o_orderkey::VARCHAR, 10, '0') || a.n || '/file' AS download_url,
      CASE WHEN a.n = 1 AND o_orderkey > 0 THEN o_orderkey END AS size_bytes, 'INC' || o_orderkey AS record_number
    FROM orders JOIN (VALUES (1), (2)) a(n) ON true WHERE o_orderkey % 9 <> 0""")
def _(v):
    def build(key, text):
        def att(n):
            return F.struct(F.concat(F.lit("att"), F.lpad(text, 10, "0"), F.lit(str(n))).alias("sys_id"),
                            (F.concat(F.lit("f"), text, F.lit(".pdf")) if n == 1 else F.lit(None).cast("string")).alias("file_name"),
                            F.lit("application/pdf").alias("content_type"), (text if n == 1 else F.lit("0")).alias("size_bytes"))

        record = F.struct(F.when(key % 9 != 0, text).otherwise("").alias("sys_id"), F.concat(F.lit("INC"), text).alias("number"),
                          F.array(att(1), att(2)).alias("attachments"))
        return F.struct(F.array(record).alias("result"))

    return _listed(connectors.servicenow(_key_payload(v, "orders", "o_orderkey", build), "https://sn.example.com"), "record_number")


@catalog.add("confluence_listing", """
    SELECT 'conf_a' || o_orderkey AS external_id, 'page file ' || o_orderkey AS filename, 'text/html' AS content_type,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://wiki.example.com/dl/' || o_orderkey END AS download_url, o_orderkey AS size_bytes,
      o_orderkey::VARCHAR AS page_id, 'T' || o_orderkey AS page_title FROM orders WHERE o_orderkey % 5 <> 0""")
def _(v):
    def build(key, text):
        att = F.struct(F.concat(F.lit("a"), text).alias("id"), F.concat(F.lit("page file "), text).alias("title"), F.lit("text/html").alias("mediaType"),
                       F.struct(key.alias("fileSize")).alias("extensions"),
                       F.struct(F.when(key % 3 != 0, F.concat(F.lit("/dl/"), text)).alias("download")).alias("_links"))
        found = F.when(key % 5 != 0, F.array(att))
        page = F.struct(text.alias("id"), F.concat(F.lit("T"), text).alias("title"),
                        F.struct(F.struct(found.alias("results")).alias("attachment")).alias("children"))
        return F.struct(F.array(page).alias("results"))

    return _listed(connectors.confluence(_key_payload(v, "orders", "o_orderkey", build), "https://wiki.example.com"), "page_id", "page_title")


@catalog.add("jira_listing", """
    SELECT 'jira_' || o_orderkey AS external_id, CASE WHEN o_orderkey % 4 = 0 THEN 'attachment' ELSE 'j' || o_orderkey || '.png' END AS filename, 'image/png' AS content_type,
      'https://jira.example.com/' || o_orderkey AS download_url, o_orderkey AS size_bytes, 'K-' || o_orderkey AS issue_key, 'S' || o_orderkey AS issue_summary,
      o_orderpriority AS author FROM orders WHERE o_orderkey % 6 <> 0""")
def _(v):
    key = F.col("o_orderkey")
    text = key.cast("string")
    att = F.struct(text.alias("id"), F.when(key % 4 != 0, F.concat(F.lit("j"), text, F.lit(".png"))).alias("filename"), F.lit("image/png").alias("mimeType"),
                   F.concat(F.lit("https://jira.example.com/"), text).alias("content"), key.alias("size"),
                   F.struct(F.col("o_orderpriority").alias("displayName")).alias("author"))
    issue = F.struct(F.concat(F.lit("K-"), text).alias("key"),
                     F.struct(F.concat(F.lit("S"), text).alias("summary"), F.when(key % 6 != 0, F.array(att)).alias("attachment")).alias("fields"))
    payload = v.table("orders").select(F.to_json(F.struct(F.array(issue).alias("issues"))).alias("payload"))
    return _listed(connectors.jira(payload), "issue_key", "issue_summary", "author")


@catalog.add("salesforce_listing", """
    SELECT 'sf_' || o_orderkey AS external_id, 'n' || o_orderkey AS filename, 'text/plain' AS content_type,
      'https://sf.example.com/services/data/v59.0/sobjects/Attachment/' || o_orderkey || '/Body' AS download_url, o_custkey AS size_bytes,
      strftime(o_orderdate, '%Y-%m-%d') AS created_date FROM orders """)
def _(v):
    key = F.col("o_orderkey").cast("string")
    rec = F.struct(key.alias("Id"), F.concat(F.lit("n"), key).alias("Name"), F.lit("text/plain").alias("ContentType"), F.col("o_custkey").alias("BodyLength"),
                   F.lit("p").alias("ParentId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("CreatedDate"))
    payload = v.table("orders").select(F.to_json(F.struct(F.array(rec).alias("records"))).alias("payload"))
    return _listed(connectors.salesforce(payload, "https://sf.example.com"), "created_date")


@catalog.add("sharepoint_listing", """
    SELECT 'sp_' || o_orderkey || '_s' || o_orderkey || '.docx' AS external_id, 's' || o_orderkey || '.docx' AS filename,
      'application/vnd.openxmlformats-officedocument.wordprocessingml.document' AS content_type,
      'https://sp.example.com/_api/web/getfilebyserverrelativeurl(''/my%20lib/' || o_orderkey || ''')/$value' AS download_url,
      CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS size_bytes, '/my lib/' || o_orderkey AS file_ref, 'Documents' AS library FROM orders WHERE o_orderkey % 8 <> 0""")
def _(v):
    def build(key, text):
        item = F.struct(text.alias("Id"), F.when(key % 8 != 0, F.concat(F.lit("s"), text, F.lit(".docx"))).alias("FileLeafRef"),
                        F.concat(F.lit("/my lib/"), text).alias("FileRef"), F.struct(F.when(key % 3 == 0, "n/a").otherwise(text).alias("Length")).alias("File"))
        return F.struct(F.struct(F.array(item).alias("results")).alias("d"))

    return _listed(connectors.sharepoint(_key_payload(v, "orders", "o_orderkey", build), "https://sp.example.com"), "file_ref", "library")


# --- workflows ------------------------------------------------------------

TRIGGER = "document_processed"


def _effects(v: Views):
    return workflows.run_workflows(v.wide.doc_ledger, v.workflow_rules, v.templates, v.workspaces, TRIGGER, v.as_of)


@catalog.add("workflow_match", sql("SELECT id AS document_id, rule_id, rule_name, pos, action_type FROM matches"))
def _(v):
    return workflows.match_workflows(v.wide.doc_ledger, v.workflow_rules, TRIGGER).drop("config")


@catalog.add("workflow_changes", sql("""
    SELECT document_id, arg_max(assigned_to, place) FILTER (assigned_to IS NOT NULL) AS assigned_to, arg_max(status, place) FILTER (status IS NOT NULL) AS status,
      arg_max(notes, place) FILTER (notes IS NOT NULL) AS reviewer_notes FROM (
      SELECT id AS document_id, rule_id * 10 + pos AS place, new_assignee AS assigned_to, new_status AS status, NULL AS notes FROM assigned
      UNION ALL SELECT id, rule_id * 10 + pos, NULL, new_status, new_notes FROM moved) GROUP BY document_id"""))
def _(v):
    return _effects(v).documents


_NOTED = """(SELECT id AS document_id, rule_id, rule_name, pos, workspace_id, 'See ' || filename AS title, status || ' ' || CASE WHEN confidence = 0 THEN '' ELSE confidence::VARCHAR END || ' '
    || coalesce(strftime(due_date, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS message FROM matches WHERE action_type = 'create_notification')"""


@catalog.add("workflow_audit", sql(f"""
    SELECT id AS document_id, workspace_id, rule_id, pos, 'workflow_assigned' AS action, 'rule=' || rule_name || ' assigned_to=' || new_assignee AS details FROM assigned
    UNION ALL SELECT id, workspace_id, rule_id, pos, 'workflow_transition', 'rule=' || rule_name || ' from=' || status || ' to=' || new_status FROM moved
    UNION ALL SELECT document_id, workspace_id, rule_id, pos, 'workflow_notification_created', 'rule=' || rule_name || ' event=document_processed type=workflow' FROM {_NOTED}
    UNION ALL SELECT document_id, workspace_id, rule_id, pos, 'workflow_email_queued', 'rule=' || rule_name || ' to=' || to_email || ' template_id=' || template_id FROM mailed
    UNION ALL SELECT id, workspace_id, rule_id, pos, 'workflow_webhook_queued', 'rule=' || rule_name || ' event=document_processed url=https://hooks.example.com/in' FROM matches
      WHERE action_type = 'webhook_post'"""))
def _(v):
    return _effects(v).audit.select("document_id", "workspace_id", "rule_id", "pos", "action", "details")


@catalog.add("workflow_notifications", sql(f"""
    SELECT id AS document_id, rule_id, pos, new_assignee AS user_id, 'assignment' AS type, 'Assigned by workflow: ' || filename AS title, 'Rule: ' || rule_name AS message FROM assigned
    UNION ALL SELECT id, rule_id, pos, NULL, 'status_change', filename || ': ' || status || ' -> ' || new_status, 'Rule: ' || rule_name FROM moved
    UNION ALL SELECT document_id, rule_id, pos, NULL, 'workflow', title, message FROM {_NOTED}"""))
def _(v):
    return _effects(v).notifications.select("document_id", "rule_id", "pos", "user_id", "type", "title", "message")


@catalog.add("workflow_outbox", sql("SELECT document_id, workspace_id, rule_id, pos, to_email, subject, body, 'pending' AS status FROM mailed"))
def _(v):
    return _effects(v).outbox.drop("created_at")


@catalog.add("workflow_webhooks", sql("""SELECT id AS document_id, rule_id, 'https://hooks.example.com/in' AS url, rule_name AS rule, status, confidence FROM matches WHERE action_type = 'webhook_post'"""))
def _(v):
    out = _effects(v).webhooks
    read = F.from_json("payload", "rule string, document struct<status:string,confidence:double>")
    return out.withColumn("p", read).select("document_id", "rule_id", "url", F.col("p.rule").alias("rule"), F.col("p.document.status").alias("status"),
                                            F.col("p.document.confidence").alias("confidence"))


@catalog.add("workflow_second_pass", sql("""
    SELECT d.id, coalesce(c.status, d.status) AS status, coalesce(c.assigned_to, d.assigned_to) AS assigned_to, CASE WHEN c.document_id IS NULL THEN d.updated_at ELSE TIMESTAMP '1998-07-01' END AS updated_at
    FROM doc_ledger d LEFT JOIN (SELECT document_id, arg_max(assigned_to, place) FILTER (assigned_to IS NOT NULL) AS assigned_to,
      arg_max(status, place) FILTER (status IS NOT NULL) AS status FROM (
      SELECT id AS document_id, rule_id * 10 + pos AS place, new_assignee AS assigned_to, new_status AS status FROM assigned
      UNION ALL SELECT id, rule_id * 10 + pos, NULL, new_status FROM moved) GROUP BY document_id) c ON c.document_id = d.id"""))
def _(v):
    return workflows.after_pass(v.doc_ledger, _effects(v), v.as_of).select("id", "status", "assigned_to", "updated_at")


def _late_rules(v):
    """The rules of other triggers, dealt to the passes that follow: by status and for overdue documents."""
    key = F.col("id")
    trigger = F.when(key == 11, "document_acknowledged").when(key == 17, "document_approved").when(key == 23, "document_assigned")
    return v.workflow_rules.withColumn("trigger_event", F.coalesce(trigger, F.col("trigger_event")))


_AFTER_FIRST = """(SELECT d.* REPLACE (coalesce(c.status, d.status) AS status, coalesce(c.assigned_to, d.assigned_to) AS assigned_to) FROM doc_ledger d LEFT JOIN (
    SELECT document_id, arg_max(assigned_to, place) FILTER (assigned_to IS NOT NULL) AS assigned_to, arg_max(status, place) FILTER (status IS NOT NULL) AS status FROM (
      SELECT id AS document_id, rule_id * 10 + pos AS place, new_assignee AS assigned_to, new_status AS status FROM assigned
      UNION ALL SELECT id, rule_id * 10 + pos, NULL, new_status FROM moved) GROUP BY document_id) c ON c.document_id = d.id)"""


@catalog.add("workflow_status_pass", sql(f"""
    SELECT d.id AS document_id, r.rule_id, r.pos, r.action_type, 'document_' || d.status AS "trigger" FROM {_AFTER_FIRST} d
    JOIN (VALUES (11, 0, 'transition', 'acknowledged'), (17, 0, 'send_template_email', 'approved'), (23, 0, 'assign', 'assigned'), (23, 1, 'transition', 'assigned'))
      r(rule_id, pos, action_type, status) ON r.status = d.status AND d.workspace_id = 'ws1' AND CASE r.rule_id WHEN 11 THEN d.confidence <= 0.25
        WHEN 17 THEN coalesce(d.doc_type IN ('complaint', 'foi_request'), false) AND d.urgency = 'high' ELSE true END"""))
def _(v):
    effects, _ = workflows.run_passes(v.wide.doc_ledger, _late_rules(v), v.templates, v.workspaces, "document_processed", v.as_of)
    return effects[1].acted.select("document_id", F.col("rule_id").cast("int").alias("rule_id"), "pos", "action_type", workflows.status_trigger().alias("trigger"))


@catalog.add("overdue_workflows", sql(f"""SELECT id, CASE WHEN late >= 3 AND coalesce(assigned_to, '') <> 'u2' THEN 'u2' WHEN late IS NOT NULL AND workspace_id = 'ws1' THEN 'u5' ELSE assigned_to END AS assigned_to
    FROM (SELECT *, CASE WHEN due_date < {AS_OF} AND status NOT IN ('approved', 'corrected', 'completed', 'archived') AND id NOT IN (
        SELECT document_id FROM notifications WHERE type = 'overdue' AND created_at >= {AS_OF} - INTERVAL 1 DAY)
      THEN date_diff('second', due_date, {AS_OF}) // 86400 END AS late FROM doc_ledger)"""))
def _(v):
    """The default of three days."""
    rules = v.workflow_rules.withColumn("trigger_event", F.when(F.col("id") == 23, "document_overdue").otherwise(F.col("trigger_event")))
    *_, written = sla.overdue_run(v.wide.doc_ledger, v.notifications, rules, v.templates, v.workspaces, v.as_of, "u2")
    return written.select("id", "assigned_to")


@catalog.add("preset_missing", """
    SELECT s_suppkey, p.name, p.trigger_event FROM supplier JOIN (VALUES ('Contracts: Auto-assign on ingestion', 'document_ingested', 0),
      ('Contracts: Notify when overdue', 'document_overdue', 1)) p(name, trigger_event, k) ON p.k = s_suppkey % 2 WHERE s_suppkey % 3 <> 0""")
def _(v):
    s = v.table("supplier")
    odd = F.col("s_suppkey") % 2 == 1
    name = F.when(odd, "Contracts: Notify when overdue").otherwise("Contracts: Auto-assign on ingestion")
    event = F.when(odd, "document_overdue").otherwise("document_ingested")
    wanted = s.select("s_suppkey", name.alias("name"), event.alias("trigger_event"), F.col("s_suppkey").cast("string").alias("scope"))
    have = s.filter("s_suppkey % 3 = 0").select(F.upper(name).alias("name"), event.alias("trigger_event"), F.col("s_suppkey").cast("string").alias("scope"))
    return workflows.missing_presets(wanted, have, ["name", "trigger_event", "scope"]).drop("scope")


def _many_rules(v: Views):
    """One rule for each part: three or four filters, some with bounds of the confidence, some with several values; a quarter are of one workspace."""
    key = F.col("p_partkey")
    kinds = choose(TYPES, key % 5)
    status = choose(STATUSES, F.expr("(p_partkey div 5) % 10"))
    channel = choose(("upload", "connector_s3", "watched_folder"), F.expr("(p_partkey div 50) % 3"))
    low = (key % 19 / F.lit(20.0)).cast("string")
    filters = F.concat(
        F.lit('{"doc_type": ["'), kinds, F.lit('", "memo"], "status": "'), status, F.lit('", "source_channel": ["'), channel, F.lit('"]'),
        F.when(key % 3 != 0, F.concat(F.lit(', "min_confidence": '), low, F.lit(', "max_confidence": "'), ((key % 19 + 1) / F.lit(20.0)).cast("string"), F.lit('"')))
        .otherwise(F.lit(', "urgency": "high"')), F.lit("}"))
    actions = F.lit('[{"type": "transition", "config": {"status": "approved"}}]')
    return spread(v.table("part")).select(
        key.cast("long").alias("id"), F.when(key % 4 == 1, F.concat(F.lit("ws"), (key % 3).cast("string"))).alias("workspace_id"),
        F.concat(F.lit("part "), key.cast("string")).alias("name"), F.lit(True).alias("enabled"), F.lit(TRIGGER).alias("trigger_event"),
        filters.alias("filters_json"), actions.alias("actions_json"))


_MANY = f"""SELECT d.id AS document_id, p.p_partkey AS rule_id FROM doc_ledger d JOIN part p ON d.doc_type = {pick(TYPES, 'p.p_partkey % 5')}
    AND d.status = {pick(STATUSES, '(p.p_partkey // 5) % 10')} AND d.source_channel = {pick(('upload', 'connector_s3', 'watched_folder'), '(p.p_partkey // 50) % 3')}
    AND (p.p_partkey % 4 <> 1 OR d.workspace_id = 'ws' || (p.p_partkey % 3))
    AND CASE WHEN p.p_partkey % 3 <> 0 THEN d.confidence BETWEEN (p.p_partkey % 19) / 20.0::DOUBLE AND (p.p_partkey % 19 + 1) / 20.0::DOUBLE ELSE d.urgency = 'high' END"""


@catalog.add("workflow_many_rules", sql(_MANY))
def _(v):
    return workflows.match_workflows(v.wide.doc_ledger, _many_rules(v), TRIGGER).select("document_id", "rule_id")


@catalog.add("workflow_rules_shuffled", sql(_MANY.replace("FROM doc_ledger d", "FROM (SELECT * FROM doc_ledger WHERE workspace_id = 'ws1') d")))
def _(v):
    """The same lookup where the rules may not be lent to every task: both sides shuffle."""
    docs = v.wide.doc_ledger.filter("workspace_id = 'ws1'")
    found = workflows.matched_actions(docs, _many_rules(v), TRIGGER, [], small=0)
    return found.select("document_id", "rule_id")


@catalog.add("workflow_stored_effects", sql(f"""
    SELECT 'audit' AS target, count(*) AS n, count(DISTINCT document_id) AS documents FROM (SELECT id AS document_id FROM assigned UNION ALL SELECT id FROM moved
      UNION ALL SELECT document_id FROM {_NOTED} UNION ALL SELECT document_id FROM mailed UNION ALL SELECT id FROM matches WHERE action_type = 'webhook_post')
    UNION ALL SELECT 'notifications', count(*), count(DISTINCT document_id) FROM (SELECT id AS document_id FROM assigned UNION ALL SELECT id FROM moved UNION ALL SELECT document_id FROM {_NOTED})
    UNION ALL SELECT 'outbox', count(*), count(DISTINCT document_id) FROM mailed
    UNION ALL SELECT 'webhooks', count(*), count(DISTINCT id) FROM matches WHERE action_type = 'webhook_post'
    UNION ALL SELECT 'documents', count(DISTINCT id), count(DISTINCT id) FROM (SELECT id FROM assigned UNION ALL SELECT id FROM moved)"""))
def _(v):
    """All effects of one pass, written once and read by five targets."""
    kept = _effects(v).stored(f"{shared_folder(v.spark)}/effects-{uuid4().hex}")
    return reduce(DataFrame.unionByName, [
        getattr(kept, name).agg(F.lit(name).alias("target"), F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("documents"))
        for name in ("audit", "notifications", "outbox", "webhooks", "documents")])


PACKS = ("gov-intake-triage", "gov-foia", "gov-permits", "biz-ap-invoices", "biz-contracts")


def _preset_tables(v: Views):
    """Two packs for every nation, one for every region; some of their rules and templates are there already."""
    n, r = v.table("nation"), v.table("region")
    chosen = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("workspace_id"),
                      F.explode(F.array(choose(PACKS, F.col("n_nationkey") % 5), choose(PACKS, F.col("n_regionkey") % 5))).alias("preset_id")).unionByName(
        r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("workspace_id"), choose(PACKS, F.col("r_regionkey") % 5).alias("preset_id")))
    have = n.filter("n_nationkey % 2 = 0").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("workspace_id"),
        F.explode(F.array(F.lit(" contracts: NOTIFY when overdue"), F.lit("Permits: Email applicant on approval"), F.lit("FOIA: Auto-assign on ingestion"))).alias("name"))
    event = (F.when(F.col("name").contains("NOTIFY"), "document_overdue").when(F.col("name").contains("Permits"), "document_approved").otherwise("other_event"))
    letters = r.select(F.when(F.col("r_regionkey") > 0, F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))).alias("workspace_id"),
                       F.when(F.col("r_regionkey") == 0, "foia STATUS update ").otherwise("Permit Decision Notice").alias("name"))
    return chosen, have.withColumn("trigger_event", event), letters


def _preset_sql(kind: str, body: str) -> str:
    rules = ", ".join(f"({i}, '{p}', '{n}', '{t}')" for i, (p, n, t, _, _) in enumerate(workflows.PRESET_RULES))
    letters = ", ".join(f"('{p}', '{n}')" for p, n, _, _ in workflows.PRESET_TEMPLATES)
    return f"""WITH chosen AS (
      SELECT DISTINCT * FROM (SELECT 'n' || n_nationkey AS workspace_id, unnest([{pick(PACKS, 'n_nationkey % 5')}, {pick(PACKS, 'n_regionkey % 5')}]) AS preset_id FROM nation
        UNION ALL SELECT 'r' || r_regionkey, {pick(PACKS, 'r_regionkey % 5')} FROM region)),
    wanted_rules AS (SELECT c.*, p.name, p.event, row_number() OVER (PARTITION BY c.workspace_id, lower(p.name), p.event ORDER BY c.preset_id) AS nth
      FROM chosen c JOIN (VALUES {rules}) p(i, preset_id, name, event) USING (preset_id)),
    new_rules AS (SELECT * FROM wanted_rules w WHERE nth = 1 AND NOT (w.workspace_id LIKE 'n%' AND substr(w.workspace_id, 2)::INT % 2 = 0
      AND (w.name, w.event) IN (VALUES ('Contracts: Notify when overdue', 'document_overdue'), ('Permits: Email applicant on approval', 'document_approved')))),
    wanted_letters AS (SELECT c.*, p.name FROM chosen c JOIN (VALUES {letters}) p(preset_id, name) USING (preset_id)),
    new_letters AS (SELECT * FROM wanted_letters w WHERE name <> 'FOIA Status Update' AND NOT (w.workspace_id LIKE 'r%' AND substr(w.workspace_id, 2)::INT > 0))
    {body}"""


@catalog.add("preset_counts", _preset_sql("counts", """SELECT c.workspace_id, c.preset_id, k.kind,
      CASE k.kind WHEN 'rules' THEN (SELECT count(*) FROM new_rules n WHERE n.workspace_id = c.workspace_id AND n.preset_id = c.preset_id)
        ELSE (SELECT count(*) FROM new_letters n WHERE n.workspace_id = c.workspace_id AND n.preset_id = c.preset_id) END AS created,
      CASE k.kind WHEN 'rules' THEN (SELECT count(*) FROM wanted_rules n WHERE n.workspace_id = c.workspace_id AND n.preset_id = c.preset_id)
          - (SELECT count(*) FROM new_rules n WHERE n.workspace_id = c.workspace_id AND n.preset_id = c.preset_id)
        ELSE (SELECT count(*) FROM wanted_letters n WHERE n.workspace_id = c.workspace_id AND n.preset_id = c.preset_id)
          - (SELECT count(*) FROM new_letters n WHERE n.workspace_id = c.workspace_id AND n.preset_id = c.preset_id) END AS skipped
    FROM chosen c, (VALUES ('rules'), ('templates')) k(kind)"""))
def _(v):
    return workflows.apply_presets(*_preset_tables(v))[2]


@catalog.add("preset_rows", _preset_sql("rows", """SELECT workspace_id, name, event AS trigger_event FROM new_rules UNION ALL SELECT workspace_id, name, 'template' FROM new_letters"""))
def _(v):
    new_rules, new_templates, _ = workflows.apply_presets(*_preset_tables(v))
    return new_rules.select("workspace_id", "name", "trigger_event").unionByName(
        new_templates.select("workspace_id", "name", F.lit("template").alias("trigger_event")))


# --- SLA, mail, sinks -----------------------------------------------------

def _scanned(v: Views):
    return sla.sla_scan(v.doc_ledger, v.notifications, v.events_as_of)


_SCAN = f"""(SELECT *, date_diff('second', due_date, {EVENTS_AS_OF}) // 86400 AS late FROM doc_ledger WHERE due_date < {EVENTS_AS_OF}
    AND status NOT IN ('approved', 'corrected', 'completed', 'archived') AND id NOT IN (
      SELECT document_id FROM notifications WHERE type = 'overdue' AND created_at >= {EVENTS_AS_OF} - INTERVAL 1 DAY))"""


@catalog.add("sla_scan", sql(f"SELECT id, late AS days_overdue FROM {_SCAN}"))
def _(v):
    return _scanned(v).select("id", "days_overdue")


@catalog.add("sla_notifications", sql(f"""SELECT id AS document_id, assigned_to AS user_id, 'Overdue: ' || filename AS title,
    'SLA due date passed (' || strftime(due_date, '%Y-%m-%dT%H:%M:%S+00:00') || '). ' || late || 'd overdue.' AS message, workspace_id FROM {_SCAN}"""))
def _(v):
    return sla.overdue_notifications(_scanned(v), v.events_as_of).select("document_id", "user_id", "title", "message", "workspace_id")


@catalog.add("escalation", sql(f"""SELECT id AS document_id, 'u2' AS assigned_to, 'Reassigned from ' || CASE WHEN coalesce(assigned_to, '') = '' THEN 'unassigned' ELSE assigned_to END
    || ' to u2 (' || late || 'd overdue)' AS details, 'Escalated: ' || filename AS title FROM {_SCAN} WHERE late >= 9000 AND coalesce(assigned_to, '') <> 'u2'"""))
def _(v):
    return sla.escalate(_scanned(v), "u2", v.events_as_of, 9000).select("document_id", "assigned_to", "details", "title")


@catalog.add("outbox_auto", sql("""
    SELECT l.id AS document_id, k.email_type, l.to_email, t.name || ' - ' || l.filename AS subject, l.letter || t.p_brand AS body
    FROM letters l JOIN (VALUES ('acknowledgment', 'acknowledgment'), ('missing_info', 'request for information'), ('status_update', 'status update')) k(email_type, hint)
      ON k.email_type = 'acknowledgment' OR (k.email_type = 'missing_info' AND l.missing <> '')
        OR (k.email_type = 'status_update' AND l.status IN ('approved', 'completed', 'assigned', 'in_progress'))
    JOIN (SELECT w.workspace_id, h.hint, arg_min(t.name, (t.name, t.id)) AS name, arg_min(t.p_brand, (t.name, t.id)) AS p_brand
        FROM (SELECT DISTINCT workspace_id FROM doc_ledger) w, (VALUES ('acknowledgment'), ('request for information'), ('status update')) h(hint)
        JOIN templates t ON (t.workspace_id IS NULL OR t.workspace_id = w.workspace_id) AND contains(lower(t.name), h.hint) GROUP BY ALL) t
      ON t.workspace_id = l.workspace_id AND t.hint = k.hint WHERE l.to_email IS NOT NULL"""))
def _(v):
    return mail.auto_mail(v.wide.doc_ledger, v.templates, v.as_of).select("document_id", "email_type", "to_email", "subject", "body")


@catalog.add("outbox_assigned", sql("""
    SELECT d.id AS document_id, u.email AS to_email, 'Desk: document assigned to you: ' || d.filename AS subject,
      'Hi ' || coalesce(u.full_name, split_part(u.email, '@', 1)) || ',' || chr(10) || chr(10) || 'A document is waiting for your review.' || chr(10) || chr(10)
      || 'File: ' || d.filename || chr(10) || 'Type: ' || coalesce(d.doc_type, 'None') || chr(10) || 'Department: ' || coalesce(d.department, 'None') || chr(10) AS body
    FROM doc_ledger d JOIN users u ON u.id = d.assigned_to WHERE u.k % 5 <> 0"""))
def _(v):
    events = v.doc_ledger.select(F.col("id").alias("document_id"), F.col("assigned_to").alias("user_id"))
    return mail.user_mail(events, v.doc_ledger, v.users, "doc_assigned", "Desk", v.as_of).select("document_id", "to_email", "subject", "body")


@catalog.add("outbox_reviewed", sql("""
    SELECT d.id AS document_id, u.email AS to_email, 'Desk: document ' || d.status || ': ' || d.filename AS subject FROM doc_ledger d JOIN users u ON u.id = d.assigned_to
    WHERE u.k % 5 <> 1 AND d.status IN ('approved', 'corrected')"""))
def _(v):
    done = v.doc_ledger.filter("status in ('approved', 'corrected')")
    return mail.user_mail(mail.review_events(done), done, v.users, "doc_review_complete", "Desk", v.as_of).select("document_id", "to_email", "subject")


@catalog.add("outbox_receipts", sql("""
    SELECT p.id, '__account__' AS document_id, u.email AS to_email, 'Desk: payment receipt ($' || printf('%.2f', p.amount_cents / 100.0::DOUBLE) || ')' AS subject,
      'We received your payment of $' || printf('%.2f', p.amount_cents / 100.0::DOUBLE) || ' for the ' || upper(left(u.plan_tier, 1)) || substr(u.plan_tier, 2) || ' plan. Thank you.' || chr(10) AS body
    FROM payments p JOIN users u ON u.id = p.user_id WHERE p.event_type = 'invoice.paid'"""))
def _(v):
    people = v.users.select(F.col("id").alias("uid"), "email", "plan_tier")
    events = v.payments.filter("event_type = 'invoice.paid'").join(people, F.col("user_id") == F.col("uid")).select(
        F.col("id").alias("event_id"), "user_id", "email", "plan_tier", "amount_cents")
    return mail.account_mail(events, v.users, "account_payment_receipt", "Desk", v.as_of).select(F.col("event_id").alias("id"), "document_id", "to_email", "subject", "body")


@catalog.add("outbox_welcome", sql("""SELECT email AS to_email, 'Welcome to Desk' AS subject, 'Hi ' || coalesce(full_name, split_part(email, '@', 1)) || ',' || chr(10) || chr(10)
    || 'Your account on Desk is ready.' || chr(10) AS body FROM users WHERE k % 5 <> 1"""))
def _(v):
    k = F.substring("id", 2, 20).cast("long")
    events = v.users.select(F.when(k % 2 == 0, F.col("id")).alias("user_id"), "email", "full_name")
    return mail.account_mail(events, v.users, "account_welcome", "Desk", v.as_of).select("to_email", "subject", "body")


@catalog.add("outbox_upgrades", sql("""SELECT user_id, '__account__' AS document_id, 'u' || user_id || '@example.com' AS to_email, 'Desk: your plan is now ' || plan AS subject,
    'Your plan on Desk has been upgraded to ' || plan || '.' || chr(10) AS body FROM (SELECT o_custkey AS user_id, o_orderkey,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Enterprise' ELSE 'Pro' END AS plan FROM orders WHERE o_orderstatus = 'P')"""))
def _(v):
    cust = F.col("o_custkey").cast("string")
    events = v.table("orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("event_id"), F.concat(F.lit("u"), cust).alias("user_id"), F.concat(F.lit("u"), cust, F.lit("@example.com")).alias("email"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "ENTERPRISE").alias("plan_tier"))
    out = mail.account_mail(events, v.users, "account_plan_change", "Desk", v.as_of)
    return out.select(F.col("event_id").alias("user_id"), "document_id", "to_email", "subject", "body")


@catalog.add("outbox_invitations", sql("""SELECT 'i' || event_id || '@example.com' AS to_email, 'You are invited to Desk' AS subject,
    CASE WHEN event_id % 2 = 0 THEN 'An administrator' ELSE event_type END || ' invites you to Desk.' || chr(10) || chr(10) || 'Create your account here:' || chr(10)
      || 'https://join/' || event_id || chr(10) || chr(10) || 'The link is valid for 7 days.' || chr(10) AS body FROM events"""))
def _(v):
    k = F.col("event_id").cast("string")
    events = v.table("events").select(F.lit(None).cast("string").alias("user_id"), F.concat(F.lit("i"), k, F.lit("@example.com")).alias("email"),
                                      F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("inviter"), F.concat(F.lit("https://join/"), k).alias("link"))
    return mail.account_mail(events, v.users, "account_invitation", "Desk", v.as_of).select("to_email", "subject", "body")


@catalog.add("delivery_update", sql("""SELECT id, CASE WHEN status <> 'pending' THEN status WHEN id % 2 = 0 THEN 'sent' ELSE 'failed' END AS status,
    CASE WHEN status = 'pending' AND id % 2 = 1 THEN 'refused' END AS error, CASE WHEN status = 'pending' AND id % 2 = 0 THEN TIMESTAMP '1998-07-01' ELSE sent_at END AS sent_at FROM emails"""))
def _(v):
    results = v.emails.filter("status = 'pending'").select("id", F.when(F.col("id") % 2 == 1, "refused").alias("error"), v.as_of.alias("sent_at"))
    return mail.delivery_update(v.emails, results).select("id", "status", "error", "sent_at")


@catalog.add("approved_export", sql("""SELECT id AS document_id, status, 'review' AS "trigger", storage_path AS source_path, '/out/' || id || '_' || filename AS export_path,
    '1998-07-01T00:00:00+00:00' AS exported_at FROM doc_ledger WHERE status IN ('approved', 'corrected')"""))
def _(v):
    return sinks.approved_export(v.doc_ledger, "/out/", "review", v.as_of)


@catalog.add("export_merge", sql("""SELECT id::VARCHAR AS document_id, CASE WHEN id % 3 = 0 THEN 'second' ELSE 'first' END AS "trigger", '/out/' || id || '_' || filename AS export_path,
    strlen(filename)::INT AS content_bytes FROM doc_ledger WHERE status IN ('approved', 'corrected')"""))
def _(v):
    """Two exports, the second of a part of the documents; each document once, as last exported."""
    place = f"{shared_folder(v.spark)}/export-{uuid4().hex}"
    for run, docs in (("1", v.doc_ledger), ("2", v.doc_ledger.filter("id % 3 = 0"))):
        done = sinks.approved_export(docs, "/out", "first" if run == "1" else "second", v.as_of)
        content = docs.select(F.col("id").alias("document_id"), F.encode("filename", "UTF-8").alias("content"))
        sinks.write_export(done, content, place, run)
    stored, bodies = sinks.read_export(v.spark, place)
    sizes = bodies.select(F.col("document_id").cast("string").alias("document_id"), F.length("content").alias("content_bytes"))
    return stored.join(sizes, "document_id").select("document_id", "trigger", "export_path", "content_bytes")


@catalog.add("processed_copies", sql("""SELECT id, CASE WHEN id % 2 = 0 THEN 'approved' ELSE status END AS status, filename FROM doc_ledger"""))
def _(v):
    """Copies of two runs: half of the documents move to another status in the second."""
    place = f"{shared_folder(v.spark)}/copies-{uuid4().hex}"
    files = v.doc_ledger.select("id", "filename", F.encode("filename", "UTF-8").alias("content"))
    sinks.write_processed_copy(files, v.doc_ledger, place, "1")
    sinks.write_processed_copy(files, v.doc_ledger.filter("id % 2 = 0").withColumn("status", F.lit("approved")), place, "2")
    return sinks.read_processed_copies(v.spark, place).select(F.col("id").cast("long").alias("id"), "status", "filename")


@catalog.add("export_audit", sql("""SELECT id AS document_id, 'approved_exported' AS action, 'clerk' AS actor,
    'status=' || status || ' trigger=review path=/out/' || id || '_' || filename AS details FROM doc_ledger WHERE status IN ('approved', 'corrected')"""))
def _(v):
    return sinks.export_audit(sinks.approved_export(v.doc_ledger, "/out", "review", v.as_of), "clerk", v.as_of).drop("created_at")


@catalog.add("csv_export", sql("""SELECT id::VARCHAR AS id, '"' || id || '","' || replace(filename, '"', '""') || '","' || status || '","' || coalesce(doc_type, '') || '","' || coalesce(department, '') || '","'
    || coalesce(assigned_to, '') || '","' || coalesce(strftime(due_date, '%Y-%m-%dT%H:%M:%S+00:00'), '') || '"' AS line
    FROM (SELECT * REPLACE ('a "b" ' || filename AS filename) FROM doc_ledger)"""))
def _(v):
    return sinks.csv_lines(v.doc_ledger.withColumn("filename", F.concat(F.lit('a "b" '), "filename")))
