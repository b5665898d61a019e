"""Queries over lists, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.functions.predicates import in_workspace_or_global, unassigned_to_triage
from clerkwise.functions.text import slug_base
from clerkwise.operators import analytics, billing, joins, listing
from clerkwise.operators.admission import admit_sliding
from clerkwise.plans.catalog import catalog
from clerkwise.plans.duck import AS_OF, EVENTS_AS_OF, sql

OPEN = "('ingested','needs_review','acknowledged','assigned','in_progress','failed')"
AUTOMATED = "('routed','approved','corrected','completed','archived')"
NO_CONTACT = "coalesce(nullif(trim(applicant_email), ''), nullif(trim(contact_email), ''), nullif(trim(email), '')) IS NULL"
BLANK = "(assigned_to IS NULL OR trim(assigned_to) = '')"
QUOTA_AS_OF = "2001-08-01 00:00:00"
PAY_AS_OF = "1998-07-01 00:00:00"


@catalog.add("list_documents", sql("""SELECT id, status, department, updated_at FROM doc_ledger
    WHERE status = 'needs_review' AND department = 'BUILDING' AND workspace_id = 'ws1' ORDER BY updated_at DESC, id LIMIT 100"""))
def _(v):
    return listing.list_documents(v.doc_ledger, v.as_of, status="needs_review", department="BUILDING", workspace_id="ws1", limit=100).select(
        "id", "status", "department", "updated_at")


@catalog.add("list_overdue", sql("""SELECT id, status, due_date, workspace_id FROM doc_ledger
    WHERE overdue AND workspace_id = 'ws1' ORDER BY updated_at DESC, id LIMIT 200"""))
def _(v):
    return listing.list_documents(v.doc_ledger, v.as_of, status="overdue", workspace_id="ws1", limit=200).select(
        "id", "status", "due_date", "workspace_id")


@catalog.add("overdue_list", sql(f"""SELECT id, due_date, date_diff('second', due_date, {AS_OF}) // 86400 AS days_overdue FROM doc_ledger
    WHERE overdue ORDER BY due_date, id LIMIT 100"""))
def _(v):
    return listing.overdue(v.doc_ledger, v.as_of, 100).select("id", "due_date", "days_overdue")


@catalog.add("overdue_documents", sql(f"""SELECT id, date_diff('second', due_date, {AS_OF}) // 86400 AS days_overdue FROM doc_ledger WHERE overdue"""))
def _(v):
    return listing.overdue(v.doc_ledger, v.as_of).select("id", "days_overdue")


@catalog.add("overdue_count", sql("SELECT count(*) AS total FROM doc_ledger WHERE overdue AND workspace_id = 'ws2'"))
def _(v):
    return analytics.overdue_count(v.doc_ledger, v.as_of, "ws2")


@catalog.add("workspace_scope", sql("SELECT workspace_id, count(*) AS total FROM doc_ledger WHERE workspace_id = 'ws0' GROUP BY ALL"))
def _(v):
    return listing.scope(v.doc_ledger, "ws0").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total"))


@catalog.add("global_or_scoped", sql("""SELECT id, name, 'ws1' AS seen_by FROM templates WHERE workspace_id = 'ws1' OR workspace_id IS NULL
    UNION ALL SELECT id, name, NULL FROM templates WHERE workspace_id IS NULL"""))
def _(v):
    scoped = listing.scope_or_global(v.templates, "ws1").select("id", "name", F.lit("ws1").alias("seen_by"))
    unscoped = v.templates.filter(in_workspace_or_global(None)).select("id", "name", F.lit(None).cast("string").alias("seen_by"))
    return scoped.unionByName(unscoped)


@catalog.add("unassigned_manual", sql(f"SELECT id FROM doc_ledger WHERE status IN ('needs_review', 'acknowledged') AND {BLANK}"))
def _(v):
    return v.doc_ledger.filter(unassigned_to_triage()).select("id")


@catalog.add("unassigned_queue", sql(f"""SELECT id, due_date, updated_at FROM doc_ledger WHERE status IN ('needs_review', 'acknowledged') AND {BLANK}
    ORDER BY due_date ASC NULLS LAST, updated_at DESC, id LIMIT 200"""))
def _(v):
    return listing.unassigned_queue(v.doc_ledger, 200).select("id", "due_date", "updated_at")


@catalog.add("assigned_to_user", sql("SELECT id, updated_at FROM doc_ledger WHERE assigned_to = 'u3' ORDER BY updated_at DESC, id LIMIT 100"))
def _(v):
    return listing.list_documents(v.doc_ledger, v.as_of, assigned_to="u3", limit=100).select("id", "updated_at")


@catalog.add("filename_search", sql("SELECT id, filename FROM doc_ledger WHERE lower(filename) LIKE '%12%.pdf%'  AND contains(lower(filename), '.pdf')"))
def _(v):
    return listing.search_filename(listing.search_filename(v.doc_ledger, " .Pdf "), "12").select("id", "filename")


@catalog.add("urgent_unassigned", sql(f"SELECT id FROM doc_ledger WHERE urgency = 'high' AND {BLANK}"))
def _(v):
    return listing.unassigned_view(listing.urgent_view(v.doc_ledger)).select("id")


@catalog.add("priority_order", sql("""SELECT id, urgency, requires_review, updated_at FROM doc_ledger
    ORDER BY (urgency = 'high')::INT DESC, overdue::INT DESC, requires_review::INT DESC, updated_at DESC, id LIMIT 100"""))
def _(v):
    return listing.priority_order(v.doc_ledger, v.as_of, 100).select("id", "urgency", "requires_review", "updated_at")


@catalog.add("review_shortlist", sql("""SELECT id, status FROM doc_ledger WHERE requires_review OR status = 'needs_review'
    ORDER BY updated_at DESC, id LIMIT 5"""))
def _(v):
    return listing.review_shortlist(v.doc_ledger, 5).select("id", "status")


@catalog.add("sweep_candidates", sql("""SELECT id, status FROM doc_ledger WHERE status IN ('needs_review', 'assigned', 'acknowledged')
    ORDER BY CASE status WHEN 'needs_review' THEN 1 WHEN 'assigned' THEN 2 ELSE 3 END, updated_at DESC, id LIMIT 2000"""))
def _(v):
    return listing.sweep_candidates(v.doc_ledger, 2000).select("id", "status")


@catalog.add("age_labels", sql(f"""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago'
    WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age
    FROM (SELECT event_id, floor((epoch_us({EVENTS_AS_OF}) - epoch_us(ts)) / 1000000.0)::BIGINT AS s FROM events)"""))
def _(v):
    from clerkwise.functions.dates import age_label

    return v.table("events").select("event_id", age_label(F.col("ts"), v.events_as_of).alias("age"))


@catalog.add("audit_page", sql("""SELECT a.id, a.document_id, a.actor, a.created_at, d.filename
    FROM (SELECT * FROM audit_events WHERE action = 'click' ORDER BY id DESC LIMIT 50 OFFSET 100) a LEFT JOIN doc_ledger d ON d.id = a.document_id"""))
def _(v):
    return listing.audit_page(v.audit_events, v.doc_ledger, 50, 100, action="click").select(
        "id", "document_id", "actor", "created_at", "filename")


@catalog.add("audit_total", sql("SELECT count(*) AS total FROM audit_events WHERE action = 'click' AND actor = '7'"))
def _(v):
    return listing.audit_total(v.audit_events, action="click", actor="7")


@catalog.add("document_trail", sql("""SELECT id, action, created_at FROM audit_events WHERE document_id = 4 ORDER BY id DESC LIMIT 50"""))
def _(v):
    return listing.document_trail(v.audit_events, 4, 50).select("id", "action", "created_at")


@catalog.add("activity_feed", sql("""SELECT a.id, a.document_id, a.action, a.actor, a.details, a.created_at, d.filename
    FROM (SELECT * FROM audit_events WHERE workspace_id = 'ws1' ORDER BY id DESC LIMIT 50) a LEFT JOIN doc_ledger d ON d.id = a.document_id"""))
def _(v):
    return listing.activity_feed(v.audit_events, v.doc_ledger, 50, "ws1").select(
        "id", "document_id", "action", "actor", "details", "created_at", "filename")


@catalog.add("notification_list", sql("""SELECT id, type, user_id FROM notifications WHERE (user_id = 'u3' OR user_id IS NULL)
    AND workspace_id = 'ws1' AND NOT is_read ORDER BY id DESC LIMIT 50"""))
def _(v):
    return listing.notifications_for(v.notifications, "u3", "ws1", unread_only=True, limit=50).select("id", "type", "user_id")


@catalog.add("unread_count", sql("""SELECT count(*) AS total FROM notifications WHERE (user_id = 'u3' OR user_id IS NULL) AND workspace_id = 'ws1' AND NOT is_read"""))
def _(v):
    return analytics.unread_count(v.notifications, "u3", "ws1")


def _invitations(v):
    e = v.table("events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("ws"), (F.col("user_id") % 3).cast("string")).alias("workspace_id"),
                    F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "revoked").otherwise("pending").alias("status"),
                    (F.col("ts") + F.make_dt_interval(F.lit(7))).alias("expires_at"))


_INVITED = """(SELECT event_id AS id, 'ws' || (user_id % 3) AS workspace_id, ts + INTERVAL 7 DAY AS expires_at,
    CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'revoked' ELSE 'pending' END AS status FROM events)"""


@catalog.add("invitation_state", f"""SELECT id, status = 'pending' AND expires_at >= {EVENTS_AS_OF} AS valid,
    CASE WHEN status <> 'pending' THEN 'Invitation has already been used or revoked.' WHEN expires_at < {EVENTS_AS_OF} THEN 'Invitation has expired.' END AS reason
    FROM {_INVITED}""")
def _(v):
    return listing.invitation_state(_invitations(v), v.events_as_of).select("id", "valid", "reason")


@catalog.add("invitation_counts", f"SELECT status, count(*) AS total FROM {_INVITED} WHERE workspace_id = 'ws1' GROUP BY status")
def _(v):
    return listing.scope(_invitations(v), "ws1").groupBy("status").agg(F.count(F.lit(1)).alias("total"))


@catalog.add("job_list", sql("SELECT id, job_type, status FROM jobs WHERE status = 'failed' ORDER BY id DESC LIMIT 50"))
def _(v):
    return listing.by_status(v.jobs, "failed", 50).select("id", "job_type", "status")


@catalog.add("payments_with_user", sql("""SELECT p.id, p.user_id, p.event_type, p.amount_cents, u.email AS user_email
    FROM (SELECT * FROM payments ORDER BY id DESC LIMIT 20) p LEFT JOIN users u ON u.id = p.user_id"""))
def _(v):
    return joins.payments_with_email(v.payments, v.users, 20).select("id", "user_id", "event_type", "amount_cents", "user_email")


@catalog.add("user_workspaces", sql("SELECT w.id, m.user_id, w.plan_tier, m.role AS member_role FROM workspaces w JOIN members m ON m.workspace_id = w.id"))
def _(v):
    return joins.user_workspaces(v.workspaces, v.members).select("id", "user_id", "plan_tier", "member_role")


@catalog.add("workspace_members", sql("""SELECT m.workspace_id, m.user_id, m.role, m.joined_at, u.email, u.full_name, 'active' AS status
    FROM members m JOIN users u ON u.id = m.user_id"""))
def _(v):
    return joins.workspace_members(v.members, v.users)


@catalog.add("default_workspace", sql("SELECT user_id, workspace_id, member_role FROM default_ws"))
def _(v):
    return joins.default_workspace(v.members, v.workspaces)


@catalog.add("connector_config", """
    SELECT s.s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN '{"own": true}' WHEN t.kind = 's3' THEN '{"global": true}' ELSE '{}' END AS config_json,
      CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey % 20 = 3 ELSE true END AS enabled
    FROM supplier s JOIN (VALUES (0, 's3'), (1, 'jira')) t(k, kind) ON t.k = s.s_suppkey % 2""")
def _(v):
    s = v.table("supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "s3").otherwise("jira")
    name = F.concat(F.lit("ws"), F.col("s_suppkey").cast("string"))
    never = F.lit(None).cast("timestamp").alias("last_sync_at")
    own = s.filter("s_suppkey % 10 = 3").select(name.alias("workspace_id"), kind.alias("connector_type"), F.lit('{"own": true}').alias("config_json"),
                                                (F.col("s_suppkey") % 20 == 3).alias("enabled"), never)
    shared = s.filter("s_suppkey = 0").select(F.lit(None).cast("string").alias("workspace_id"), F.lit("s3").alias("connector_type"),
                                              F.lit('{"global": true}').alias("config_json"), F.lit(True).alias("enabled"), never)
    wanted = s.select("s_suppkey", name.alias("workspace_id"), kind.alias("connector_type"))
    return joins.resolve_configs(wanted, own.unionByName(shared)).select("s_suppkey", "config_json", "enabled")


@catalog.add("payment_accounts", sql("""
    SELECT p.id, u.id AS user_id, coalesce(w.id, d.workspace_id) AS workspace_id
    FROM (SELECT id, 'cus_' || (l_partkey % 400) AS customer_id FROM payments) p LEFT JOIN workspaces w ON w.stripe_customer_id = p.customer_id
    LEFT JOIN users u ON u.stripe_customer_id = p.customer_id LEFT JOIN default_ws d ON d.user_id = u.id"""))
def _(v):
    events = v.payments.select("id", F.concat(F.lit("cus_"), (F.col("l_partkey") % 400).cast("string")).alias("customer_id"))
    default = joins.default_workspace(v.members, v.workspaces)
    return joins.resolve_payment_accounts(events, v.workspaces, v.users, default).select("id", "user_id", "workspace_id")


@catalog.add("bulk_lookup", sql("""SELECT r.event_id, r.document_id, d.filename, CASE WHEN d.id IS NULL THEN 'not found' END AS error
    FROM (SELECT event_id, event_id * 2 AS document_id FROM events) r LEFT JOIN doc_ledger d ON d.id = r.document_id"""))
def _(v):
    wanted = v.table("events").select("event_id", (F.col("event_id") * 2).alias("document_id"))
    return joins.lookup_ids(wanted, v.doc_ledger.select("id", "filename"))


@catalog.add("audit_rows", sql("""SELECT a.id, a.document_id, coalesce(a.workspace_id, d.workspace_id) AS workspace_id
    FROM audit_events a LEFT JOIN doc_ledger d ON d.id = a.document_id"""))
def _(v):
    return joins.audit_rows(v.audit_events, v.doc_ledger).select("id", "document_id", "workspace_id")


@catalog.add("notification_rows", sql("""SELECT a.id, a.document_id, coalesce(a.workspace_id, d.workspace_id) AS workspace_id, false AS is_read
    FROM audit_events a LEFT JOIN doc_ledger d ON d.id = a.document_id"""))
def _(v):
    return joins.notification_rows(v.audit_events, v.doc_ledger).select("id", "document_id", "workspace_id", "is_read")


@catalog.add("slug_unique", r"""
    SELECT k, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_at, k) AS n
    FROM (SELECT c_custkey AS k, TIMESTAMP '1995-01-01' + to_days((c_custkey % 97)::INT) AS created_at,
      trim(regexp_replace(lower(CASE c_custkey % 3 WHEN 0 THEN 'City Hall!' WHEN 1 THEN '  Town -- Works ' ELSE c_mktsegment || ' #' || (c_custkey % 5) END),
        '[^a-z0-9]+', '-', 'g'), '-') AS base FROM customer))""")
def _(v):
    c = v.table("customer")
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "City Hall!").when(key % 3 == 1, "  Town -- Works ").otherwise(
        F.concat("c_mktsegment", F.lit(" #"), (key % 5).cast("string")))
    named = c.select(key.alias("k"), name.alias("name"), (F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval((key % 97).cast("int"))).alias("created_at"))
    return joins.unique_slugs(named, ["created_at", "k"], slug_base(F.col("name"), 64)).select("k", "slug")


@catalog.add("queue_rollup", sql("""SELECT count(*) AS total, count_if(status = 'needs_review')::BIGINT AS needs_review,
    count_if(status IN ('routed', 'approved', 'corrected', 'acknowledged', 'assigned', 'in_progress', 'completed'))::BIGINT AS ready FROM doc_ledger"""))
def _(v):
    return analytics.queue_totals(analytics.queue_snapshot(v.doc_ledger))


@catalog.add("ledger_queues", sql("""SELECT coalesce(department, 'Unassigned') AS department, count(*) AS total,
    count_if(status = 'needs_review')::BIGINT AS needs_review,
    count_if(status IN ('routed', 'approved', 'corrected', 'acknowledged', 'assigned', 'in_progress', 'completed'))::BIGINT AS ready
    FROM doc_ledger WHERE workspace_id = 'ws2' GROUP BY ALL"""))
def _(v):
    return analytics.queue_snapshot(v.doc_ledger, "ws2")


@catalog.add("analytics_totals", sql(f"""
    SELECT total_documents, needs_review, routed_or_approved, automated_documents, average_confidence, manual_unassigned, missing_contact_email, overdue,
      (SELECT count(*) FROM emails WHERE workspace_id = 'ws1' AND status = 'sent' AND sent_at >= {AS_OF}) AS emails_sent_today,
      greatest(total_documents - automated_documents, 0) AS manual_documents, round(automated_documents / total_documents, 4) AS automation_rate,
      round((total_documents - automated_documents) / total_documents, 4) AS manual_rate
    FROM (SELECT count(*) AS total_documents, count_if(requires_review)::BIGINT AS needs_review,
      count_if(status IN ('routed', 'approved', 'corrected'))::BIGINT AS routed_or_approved, count_if(status IN {AUTOMATED})::BIGINT AS automated_documents,
      round(avg(coalesce(confidence, 0)), 4) AS average_confidence, count_if(status IN {OPEN} AND {BLANK})::BIGINT AS manual_unassigned,
      count_if(status IN {OPEN} AND {NO_CONTACT})::BIGINT AS missing_contact_email, count_if(overdue)::BIGINT AS overdue
      FROM doc_ledger WHERE workspace_id = 'ws1')"""))
def _(v):
    return analytics.analytics_totals(v.doc_ledger, v.emails, v.as_of, "ws1")


@catalog.add("by_type", sql("SELECT coalesce(doc_type, 'unclassified') AS label, count(*) AS count FROM doc_ledger GROUP BY ALL"))
def _(v):
    return analytics.counts_by(v.doc_ledger, "doc_type", "unclassified")


@catalog.add("by_status", sql("SELECT status AS label, count(*) AS count FROM doc_ledger WHERE workspace_id = 'ws0' GROUP BY ALL"))
def _(v):
    return analytics.counts_by(v.doc_ledger, "status", workspace_id="ws0")


@catalog.add("manual_unassigned", sql(f"SELECT workspace_id, count_if(status IN {OPEN} AND {BLANK})::BIGINT AS manual_unassigned FROM doc_ledger GROUP BY ALL"))
def _(v):
    return analytics.manual_unassigned(v.doc_ledger, ["workspace_id"])


@catalog.add("missing_contact", sql(f"SELECT workspace_id, count_if(status IN {OPEN} AND {NO_CONTACT})::BIGINT AS missing_contact_email FROM doc_ledger GROUP BY ALL"))
def _(v):
    return analytics.missing_contact(v.doc_ledger, ["workspace_id"])


@catalog.add("triage_count", sql(f"SELECT count(*) AS total FROM doc_ledger WHERE status IN ('needs_review', 'acknowledged') AND {BLANK} AND workspace_id = 'ws1'"))
def _(v):
    return analytics.triage_count(v.doc_ledger, "ws1")


@catalog.add("emails_sent_today", sql(f"SELECT workspace_id, count_if(status = 'sent' AND sent_at >= {AS_OF})::BIGINT AS total FROM emails GROUP BY ALL"))
def _(v):
    return v.emails.groupBy("workspace_id").agg(analytics.emails_sent_since(v.as_of).alias("total"))


@catalog.add("documents_this_month", sql("SELECT workspace_id, count(*) AS used FROM doc_ledger WHERE created_at >= TIMESTAMP '1998-07-01' GROUP BY ALL"))
def _(v):
    return billing.documents_this_month(v.doc_ledger, instant("1998-07-19 08:00:00"))


@catalog.add("user_documents_this_month", sql("SELECT assigned_to, count(*) AS used FROM doc_ledger WHERE created_at >= TIMESTAMP '1996-03-01' GROUP BY ALL"))
def _(v):
    return billing.documents_this_month(v.doc_ledger, instant("1996-03-19 08:00:00"), "assigned_to")


_QUOTA = """(SELECT w.id AS workspace_id, w.plan_tier, coalesce(u.used, 0) AS used, CASE w.plan_tier WHEN 'free' THEN 50 WHEN 'pro' THEN 5000 END AS cap
    FROM workspaces w LEFT JOIN (SELECT workspace_id, count(*) AS used FROM doc_ledger WHERE created_at >= TIMESTAMP '%s' GROUP BY ALL) u
    ON u.workspace_id = w.id)"""


@catalog.add("month_quota", sql(f"""SELECT workspace_id, plan_tier, used, cap::BIGINT AS "limit", cap IS NULL OR used < cap AS allowed,
    plan_tier <> 'free' AS connectors_allowed, plan_tier <> 'free' AS replies_allowed FROM {_QUOTA % '2001-07-01'}"""))
def _(v):
    return billing.quota_check(v.doc_ledger, v.workspaces, instant("2001-07-15 00:00:00"))


@catalog.add("quota_admission", sql(f"""SELECT b.id, q.cap IS NULL OR b.n <= greatest(q.cap - q.used, 0) AS allowed
    FROM (SELECT id, workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at, id) AS n FROM doc_ledger) b
    JOIN {_QUOTA % '2001-08-01'} q ON q.workspace_id = b.workspace_id"""))
def _(v):
    quota = billing.quota_check(v.doc_ledger, v.workspaces, instant(QUOTA_AS_OF))
    batch = v.doc_ledger.select("id", "workspace_id", "created_at")
    return billing.admit_batch(batch, quota, ["created_at", "id"]).select("id", "allowed")


@catalog.add("billing_stats", sql(f"""
    SELECT 'active_subscriptions' AS metric, count_if(status = 'active')::BIGINT AS value FROM subscriptions
    UNION ALL SELECT 'mrr_cents', coalesce(sum(CASE plan_tier WHEN 'pro' THEN 2900 WHEN 'enterprise' THEN 9900 ELSE 0 END)
      FILTER (status = 'active' AND billing_type = 'monthly'), 0)::BIGINT FROM subscriptions
    UNION ALL SELECT 'revenue_last_30_days_cents', coalesce(sum(amount_cents) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY
      AND event_type IN ('checkout.session.completed', 'invoice.paid')), 0)::BIGINT FROM payments"""))
def _(v):
    return billing.billing_stats(v.subscriptions, v.payments, v.as_of)


@catalog.add("mrr_by_plan", sql("""SELECT plan_tier, count(*) AS total, (count(*) * CASE plan_tier WHEN 'pro' THEN 2900 WHEN 'enterprise' THEN 9900 ELSE 0 END)::BIGINT AS mrr_cents
    FROM subscriptions WHERE status = 'active' AND billing_type = 'monthly' GROUP BY plan_tier"""))
def _(v):
    return billing.mrr_by_plan(v.subscriptions)


@catalog.add("plan_distribution", sql("SELECT plan_tier, count(*) AS total FROM users GROUP BY ALL"))
def _(v):
    return billing.plan_distribution(v.users)


@catalog.add("system_health", sql(f"""
    SELECT 'jobs_queued' AS metric, count_if(status = 'queued')::BIGINT AS value FROM jobs
    UNION ALL SELECT 'jobs_running', count_if(status IN ('running', 'in_progress'))::BIGINT FROM jobs
    UNION ALL SELECT 'jobs_failed', count_if(status = 'failed')::BIGINT FROM jobs
    UNION ALL SELECT 'documents_total', count(*) FROM doc_ledger WHERE created_at >= {AS_OF} - INTERVAL 1 DAY
    UNION ALL SELECT 'documents_auto_routed', count_if(status IN {AUTOMATED} AND NOT requires_review)::BIGINT FROM doc_ledger WHERE created_at >= {AS_OF} - INTERVAL 1 DAY
    UNION ALL SELECT 'documents_needs_review', count_if(requires_review OR status = 'needs_review')::BIGINT FROM doc_ledger WHERE created_at >= {AS_OF} - INTERVAL 1 DAY
    UNION ALL SELECT 'documents_failed', count_if(status = 'failed')::BIGINT FROM doc_ledger WHERE created_at >= {AS_OF} - INTERVAL 1 DAY
    UNION ALL SELECT 'audit_errors', count_if(lower(action) LIKE '%error%')::BIGINT FROM audit_events WHERE created_at >= {AS_OF} - INTERVAL 1 DAY
    UNION ALL SELECT 'emails_sent', count_if(status = 'sent')::BIGINT FROM emails WHERE created_at >= {AS_OF} - INTERVAL 1 DAY
    UNION ALL SELECT 'emails_failed', count_if(status = 'failed')::BIGINT FROM emails WHERE created_at >= {AS_OF} - INTERVAL 1 DAY"""))
def _(v):
    return analytics.system_health(v.jobs, v.doc_ledger, v.audit_events, v.emails, v.as_of, "error")


@catalog.add("sync_counts", sql("SELECT connector_type, count(*) AS total_imported FROM sync_ledger GROUP BY ALL"))
def _(v):
    from clerkwise.operators.imports import sync_counts

    return sync_counts(v.sync_ledger)


@catalog.add("latency_histogram", sql("""
    SELECT method, path, b.le, count_if(latency <= b.bound)::BIGINT AS cumulative_count FROM requests
    JOIN (VALUES ('0.01', 0.01::DOUBLE), ('0.03', 0.03), ('0.1', 0.1), ('0.3', 0.3), ('1.0', 1.0), ('3.0', 3.0), ('10.0', 10.0),
      ('+Inf', 'inf'::DOUBLE)) b(le, bound) ON true GROUP BY ALL"""))
def _(v):
    return analytics.latency_histogram(v.requests, ["method", "path"])


@catalog.add("request_counter", sql("SELECT method, path, status, count(*) AS requests FROM requests GROUP BY ALL"))
def _(v):
    return analytics.request_counter(v.requests, ["method", "path", "status"])


@catalog.add("platform_counts", f"""
    SELECT 'active_api_keys' AS metric, count_if(s_suppkey % 3 <> 0)::BIGINT AS value FROM supplier
    UNION ALL SELECT 'pending_invitations', count_if(status = 'pending')::BIGINT FROM {_INVITED} WHERE workspace_id = 'ws1'""")
def _(v):
    keys = v.table("supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "revoked").otherwise("active").alias("status"))
    return analytics.platform_counts(keys, _invitations(v), "ws1")


@catalog.add("latest_row", sql("""SELECT actor, id, action, created_at FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY id DESC) AS n FROM audit_events) WHERE n = 1"""))
def _(v):
    return joins.latest_row(v.audit_events.select("actor", "id", "action", "created_at"), ["actor"], "id")


@catalog.add("active_subscription", sql("SELECT user_id, id, plan_tier, status, created_at FROM active_subs"))
def _(v):
    return joins.active_subscription(v.subscriptions, ["user_id"])


@catalog.add("effective_plan", sql("""SELECT u.id AS user_id, d.workspace_id, coalesce(s.plan_tier, w.plan_tier, u.plan_tier, 'free') AS plan_tier,
    coalesce(s.status, 'active') AS status FROM users u LEFT JOIN default_ws d ON d.user_id = u.id LEFT JOIN workspaces w ON w.id = d.workspace_id
    LEFT JOIN active_subs s ON s.user_id = u.id"""))
def _(v):
    return joins.effective_plan(v.users, v.members, v.workspaces, v.subscriptions)


@catalog.add("subscription_fold", sql("""
    SELECT subscription_id, arg_max(status, place) FILTER (status IS NOT NULL) AS status, arg_max(plan, place) FILTER (plan IS NOT NULL) AS plan_tier,
      arg_max(period_end, place) FILTER (kind = 'paid' AND period_end IS NOT NULL) AS current_period_end,
      arg_max(created_at, place) FILTER (ended) AS canceled_at
    FROM (SELECT *, CASE WHEN kind IN ('checkout', 'paid') THEN 'active' WHEN kind = 'failed' THEN 'past_due'
        WHEN ended THEN 'canceled' WHEN kind = 'updated' THEN mapped END AS status,
        CASE WHEN kind = 'checkout' THEN coalesce(plan_tier, 'pro') WHEN ended THEN 'free' END AS plan
      FROM (SELECT *, kind = 'deleted' OR (kind = 'updated' AND mapped = 'canceled') AS ended FROM (
        SELECT *, row_number() OVER (PARTITION BY subscription_id, event_id ORDER BY place) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY created_at, sequence, event_id, event_type, provider_status NULLS FIRST,
            plan_tier NULLS FIRST, period_end NULLS FIRST) AS place FROM sub_events)) WHERE n = 1)
      QUALIFY place >= min(place) FILTER (kind = 'checkout') OVER (PARTITION BY subscription_id))
    WHERE status IS NOT NULL GROUP BY subscription_id"""))
def _(v):
    return billing.subscription_fold(v.wide.subscription_events)


ADMISSION_SQL = """
    WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (SELECT event_id, user_id, n, true AS allowed, 1 AS remaining, [t] AS recent FROM ev WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.n, len(w.live) < 2, CASE WHEN len(w.live) < 2 THEN 2 - len(w.live) - 1 ELSE 0 END::INT,
        CASE WHEN len(w.live) < 2 THEN list_append(w.live, e.t) ELSE w.live END
      FROM (SELECT k.*, list_filter(k.recent, lambda x: x >= e2.t - 86400000000) AS live FROM walk k JOIN ev e2 ON e2.user_id = k.user_id AND e2.n = k.n + 1) w
      JOIN ev e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, allowed, remaining FROM walk"""


_SATURATED_SQL = ADMISSION_SQL.replace(
    "SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
    "SELECT event_id, user_id % 11 AS user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 11 ORDER BY ts, event_id) AS n FROM events"
).replace("86400000000", "3600000000")


@catalog.add("admission_saturated", _SATURATED_SQL)
def _(v):
    """Few keys, far more events than an hour admits, hundreds of blocks for each key."""
    busy = v.requests.withColumn("key", F.col("user_id") % 11)
    return admit_sliding(busy, "key", "ts", "event_id", 2, 3600).select("event_id", "allowed", "remaining")


@catalog.add("admission_hot_key", ADMISSION_SQL.replace(
    "SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
    "SELECT event_id, u AS user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS n FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS u FROM events)"
).replace("86400000000", "3600000000"))
def _(v):
    """One key holds a third of all events and never rests; its blocks are decided side by side."""
    hot = v.requests.withColumn("key", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    return admit_sliding(hot, "key", "ts", "event_id", 2, 3600).select("event_id", "allowed", "remaining")


@catalog.add("audit_deep_page", sql("""SELECT a.id, a.document_id, a.actor, d.filename
    FROM (SELECT * FROM audit_events ORDER BY id DESC LIMIT 40 OFFSET 700) a LEFT JOIN doc_ledger d ON d.id = a.document_id"""))
def _(v):
    """A page far down, found by counts of ranges of ids; the ranges hold so few rows that finer ones have to be counted."""
    page = listing.page_by_ranges(v.audit_events, "id", 40, 700, enough=5)
    return listing.with_filename(page, v.doc_ledger).select("id", "document_id", "actor", "filename")


@catalog.add("sliding_admission", ADMISSION_SQL)
def _(v):
    return admit_sliding(v.requests, "user_id", "ts", "event_id", 2, 86400).select("event_id", "allowed", "remaining")
