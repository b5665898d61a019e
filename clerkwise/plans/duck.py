"""The derived tables in DuckDB SQL, for the correctness check."""

from __future__ import annotations

import re

from clerkwise.functions.scores import URGENT_WORDS
from clerkwise.functions.text import FIELD_PATTERNS
from clerkwise.operators.rules import DEFAULT_RULES
from clerkwise.plans.views import HEADS, STATUSES, TYPES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(values, index: str) -> str:
    return "[" + ", ".join(lit(v) for v in values) + f"][({index}) + 1]"


def pattern(name: str) -> str:
    return lit(FIELD_PATTERNS[name].replace("(?iU)", "(?i)"))


def case_by_type(index: int, default: str) -> str:
    """CASE over doc_type giving the rule value at ``index`` of the default rules."""
    cases = " ".join(f"WHEN {lit(r[0])} THEN {value(r[index])}" for r in DEFAULT_RULES)
    return f"CASE doc_type {cases} ELSE {default} END"


def value(v) -> str:
    return lit(v) if isinstance(v, str) else "[" + ", ".join(lit(x) for x in v) + "]" if v else "[]::VARCHAR[]"


def hits(i: int) -> str:
    words = DEFAULT_RULES[i][1]
    return " + ".join(f"contains(low, {lit(w)})::INT" for w in words) or "0"


RULE_COUNT = len(DEFAULT_RULES) - 1
SLA = {"complaint": 5, "building_permit": 30, "court_filing": 0}
SLA_CASE = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLA.items()) + " END"
DONE = "('approved','corrected','completed','archived')"
AS_OF = "TIMESTAMP '1998-07-01 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
EDGES = """(VALUES ('ingested','needs_review'),('ingested','routed'),('needs_review','acknowledged'),
('needs_review','approved'),('needs_review','corrected'),('routed','acknowledged'),('routed','approved'),
('acknowledged','assigned'),('acknowledged','approved'),('acknowledged','in_progress'),('assigned','in_progress'),
('assigned','approved'),('in_progress','completed'),('in_progress','approved'),('completed','archived'),
('approved','archived'),('corrected','archived'),('failed','needs_review'),('failed','ingested')) e(source, target)"""

_FIELD_COLUMNS = ", ".join(
    f"nullif(trim(regexp_extract(text, {pattern(n)}, 1)), '') AS {n}" for n in FIELD_PATTERNS)

_REQUIRED = case_by_type(3, "['applicant_name','date']")
_HAVE = " ".join(f"WHEN '{n}' THEN {n} IS NULL OR {n} = ''" for n in FIELD_PATTERNS)
URGENT = " OR ".join(f"contains(lower(text), {lit(w)})" for w in URGENT_WORDS)


def judged(source: str, threshold: str = "0.82", forced: str = "") -> str:
    """Validation, score and flag over rows with doc_type, cc and fields."""
    more = f" OR doc_type IN ({forced})" if forced else ""
    return f"""SELECT *, round(score, 4) AS confidence, (score < {threshold} OR n_errors > 0{more}) AS requires_review,
      {SLA_CASE} AS sla_days
    FROM (SELECT *, greatest(least(cc, 0.99) - least(n_errors * 0.08, 0.35), 0.0) AS score
    FROM (SELECT *, len(missing) + (coalesce(parcel_number <> '' AND NOT regexp_matches(parcel_number, '^[A-Za-z0-9-]{{4,30}}$'), false))::INT
        + (coalesce(length(date) < 6, false))::INT AS n_errors,
      array_to_string(missing, ',') AS missing_fields,
      array_to_string(list_transform(missing, lambda f: 'Missing required field: ' || f), ';') AS validation_errors
    FROM (SELECT *, list_filter({_REQUIRED}, lambda f: CASE f {_HAVE} ELSE true END) AS missing FROM {source})))"""


VIEWS: dict[str, str] = {
    "intake_docs": f"""SELECT o_orderkey AS id, concat_ws(chr(10), {pick(HEADS, 'o_orderkey % 8')},
        CASE WHEN o_orderkey % 5 <> 0 THEN 'Applicant: ' || n_name END,
        CASE WHEN o_orderkey % 7 <> 0 THEN 'Address: ' || (o_orderkey % 900) || ' Main St' END,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'Parcel Number: P-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') END,
        CASE WHEN o_orderkey % 16 = 6 THEN 'Case Number: C-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') END,
        'Date: ' || strftime(o_orderdate, '%m/%d/%Y'), 'Amount: $' || printf('%.2f', o_totalprice),
        CASE WHEN o_orderkey % 4 = 0 THEN 'Email: user' || o_custkey || '@example.com' END,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'This is urgent' END) AS text,
        o_orderdate AS created_at, 'letter_' || o_orderkey || '.txt' AS filename
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fields": f"SELECT *, {_FIELD_COLUMNS} FROM intake_docs",
    "hits": f"SELECT *, {', '.join(f'{hits(i)} AS h{i}' for i in range(RULE_COUNT))} FROM (SELECT *, lower(text) AS low FROM fields)",
    "best": f"SELECT *, greatest({', '.join(f'h{i} * 100 + {99 - i}' for i in range(RULE_COUNT))}) AS b FROM hits",
    "classified": f"""SELECT *, CASE WHEN b < 100 THEN 'other' ELSE {pick([r[0] for r in DEFAULT_RULES], '99 - b % 100')} END AS doc_type,
        round(CASE b // 100 WHEN 0 THEN 0.45 WHEN 1 THEN 0.65::DOUBLE + (1.0::DOUBLE / n) * 0.08 WHEN 2 THEN 0.78::DOUBLE + (2.0::DOUBLE / n) * 0.08
          ELSE least(0.86::DOUBLE + least((b // 100 - 3) * 0.03::DOUBLE, 0.1), 0.99) END, 4) AS cc,
        CASE WHEN b < 100 THEN '' ELSE array_to_string(list_filter(words, lambda w: contains(low, w)), ',') END AS matched_keywords
        FROM (SELECT *, len(words) AS n FROM (SELECT *, [{', '.join(value(r[1]) for r in DEFAULT_RULES)}][99 - b % 100 + 1] AS words FROM best))""",
    "processed": judged("""(SELECT *, CASE WHEN %s THEN 'high' ELSE 'normal' END AS urgency, %s AS department FROM classified)"""
                        % (URGENT, case_by_type(2, "'General Intake'"))),
    "doc_ledger": f"""SELECT *, CASE WHEN sla_days IS NOT NULL THEN created_at + to_days(sla_days) END AS due_date,
          coalesce(due_date < {AS_OF} AND status NOT IN {DONE}, false) AS overdue
        FROM (SELECT o_orderkey AS id, 'ws' || (o_custkey % 3) AS workspace_id,
        'File_' || o_orderkey || {pick(('.txt', '.PDF', '.docx'), 'o_orderkey % 3')} AS filename, 'store/' || o_orderkey AS storage_path,
        {pick(('upload', 'connector_s3', 'watched_folder'), 'o_custkey % 3')} AS source_channel,
        {pick(STATUSES, '(o_orderkey // 3) % 10')} AS status,
        CASE WHEN o_orderkey % 7 < 5 THEN {pick(TYPES, 'o_orderkey % 7 % 5')} END AS doc_type,
        CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END AS department,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'normal' END AS urgency,
        (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_orderkey % 4 = 0 AS requires_review,
        CASE WHEN o_orderkey % 5 <> 0 THEN c_name END AS applicant_name,
        CASE WHEN o_orderkey % 6 = 0 THEN 'user' || o_custkey || '@example.com' WHEN o_orderkey % 6 = 1 THEN 'not an address' END AS applicant_email,
        CASE WHEN o_orderkey % 6 = 1 THEN 'user' || o_custkey || '@example.com' WHEN o_orderkey % 6 = 2 THEN '  ' END AS contact_email,
        CASE WHEN o_orderkey % 4 = 0 THEN 'user' || o_custkey || '@example.com' END AS email,
        concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'applicant_name' END, CASE WHEN o_orderkey % 9 = 0 THEN 'date' END) AS missing,
        o_orderdate AS created_at, o_orderdate + to_days((o_custkey % 10)::INT) AS updated_at,
        CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 14 WHEN '5-LOW' THEN 30 END AS sla_days,
        CASE WHEN o_orderkey % 5 = 1 THEN ' ' WHEN o_orderkey % 5 > 1 THEN 'u' || (o_orderkey % 7) END AS assigned_to
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "audit_events": """SELECT event_id AS id, event_id * 2 AS document_id, event_type AS action, user_id::VARCHAR AS actor, props AS details,
        ts AS created_at, CASE WHEN event_id % 3 = 0 THEN 'ws' || (user_id % 3) END AS workspace_id FROM events""",
    "notifications": """SELECT event_id AS id, event_id * 2 AS document_id, CASE WHEN event_type = 'error' THEN 'overdue' ELSE event_type END AS type,
        CASE WHEN event_id % 4 <> 0 THEN 'u' || (user_id % 7) END AS user_id, 'ws' || (user_id % 3) AS workspace_id,
        event_id % 3 = 0 AS is_read, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at FROM events""",
    "users": f"""SELECT 'u' || c_custkey AS id, c_custkey AS k, 'user' || c_custkey || '@example.com' AS email,
        CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 50 = 7 THEN 'admin' ELSE 'member' END AS role,
        {pick(('free', 'pro', 'enterprise'), 'c_custkey % 3')} AS plan_tier,
        CASE WHEN c_custkey % 2 = 0 THEN 'cus_' || c_custkey END AS stripe_customer_id,
        TIMESTAMP '1995-01-01' + to_days((c_custkey % 1000)::INT) AS created_at FROM customer""",
    "workspaces": f"""SELECT 'ws' || s_suppkey AS id, s_suppkey AS k,
        CASE s_suppkey % 3 WHEN 0 THEN 'City Hall!' WHEN 1 THEN '  Town -- Works ' ELSE s_name END AS name, 'u' || (s_suppkey * 3) AS owner_id,
        {pick(('free', 'pro', 'enterprise'), 's_suppkey % 3')} AS plan_tier,
        CASE WHEN s_suppkey % 4 = 0 THEN 'cus_' || (s_suppkey * 2) END AS stripe_customer_id,
        TIMESTAMP '1995-01-01' + to_days((s_suppkey % 97)::INT) AS created_at FROM supplier""",
    "members": """SELECT 'ws' || w AS workspace_id, 'u' || c_custkey AS user_id, role, TIMESTAMP '1995-06-01' + to_days((c_custkey % 30)::INT) AS joined_at
        FROM (SELECT c_custkey % 10 AS w, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'admin' ELSE 'member' END AS role FROM customer
        UNION ALL SELECT c_custkey % 7 + 1, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'member' END FROM customer
        WHERE c_custkey % 7 + 1 <> c_custkey % 10)""",
    "default_ws": """SELECT user_id, workspace_id, role AS member_role FROM (SELECT m.*, row_number() OVER (PARTITION BY user_id
        ORDER BY (role <> 'admin')::INT, w.created_at, workspace_id) AS n FROM members m JOIN workspaces w ON w.id = m.workspace_id) WHERE n = 1""",
    "subscriptions": """SELECT o_orderkey AS id, 'u' || o_custkey AS user_id, 'ws' || (o_custkey % 10) AS workspace_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'enterprise' WHEN '2-HIGH' THEN 'pro' ELSE 'free' END AS plan_tier,
        CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'lifetime' END AS billing_type,
        CASE o_orderstatus WHEN 'P' THEN 'active' WHEN 'F' THEN 'past_due' ELSE 'canceled' END AS status, o_orderdate AS created_at FROM orders""",
    "active_subs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n
        FROM subscriptions WHERE status IN ('active', 'past_due')) WHERE n = 1""",
    "payments": """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 5 <> 0 THEN 'u' || l_suppkey END AS user_id,
        CASE l_returnflag WHEN 'A' THEN 'checkout.session.completed' WHEN 'R' THEN 'invoice.paid' ELSE 'invoice.payment_failed' END AS event_type,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, l_shipdate AS created_at, l_partkey FROM lineitem""",
    "jobs": f"""SELECT event_id AS id, event_type AS job_type, {pick(('queued', 'running', 'in_progress', 'failed', 'completed'), 'event_id % 5')} AS status,
        (event_id % 4)::INT AS attempts, 3 AS max_attempts, ts AS created_at, ts AS started_at FROM events""",
    "emails": f"""SELECT o_orderkey AS id, 'ws' || (o_custkey % 3) AS workspace_id, {pick(('sent', 'pending', 'failed'), 'o_orderkey % 3')} AS status,
        o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS sent_at FROM orders""",
    "templates": """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN 'ws' || (p_partkey % 3) END AS workspace_id,
        CASE p_partkey % 40 WHEN 3 THEN 'Acknowledgment ' || p_partkey WHEN 4 THEN 'Request for Information ' || p_partkey
          WHEN 5 THEN 'Status Update ' || p_partkey ELSE p_name || ' ' || p_partkey END AS name, p_brand FROM part""",
    "letters": """SELECT *, CASE WHEN applicant_email LIKE '%@%.%' THEN applicant_email WHEN contact_email LIKE '%@%.%' THEN contact_email
          ELSE email END AS to_email,
        'Dear ' || coalesce(applicant_name, '{{applicant_name}}') || ',' || chr(10) || filename || ' (' || coalesce(doc_type, 'None') || ') is '
          || status || ' at ' || coalesce(department, 'None') || '. {{unknown}} Ref ' || id || ' ' AS letter FROM doc_ledger""",
    "rules": """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 <> 0 THEN 'ws' || (n_nationkey % 3 - 1) END AS workspace_id,
        'rule ' || n_name AS name, n_nationkey % 13 <> 5 AS enabled,
        CASE WHEN n_nationkey % 6 = 5 THEN 'document_ingested' ELSE 'document_processed' END AS trigger_event FROM nation""",
    "matches": """SELECT d.*, r.id AS rule_id, r.name AS rule_name, a.pos, a.action_type, r.id % 5 AS kind FROM doc_ledger d
        JOIN rules r ON (r.workspace_id IS NULL OR r.workspace_id = d.workspace_id) AND r.enabled AND r.trigger_event = 'document_processed'
          AND CASE r.id % 8 WHEN 0 THEN true WHEN 1 THEN coalesce(d.doc_type IN ('complaint', 'foi_request'), false) AND d.urgency = 'high'
            WHEN 2 THEN coalesce(d.department = 'BUILDING', false) AND d.confidence >= 0.5 WHEN 3 THEN d.confidence <= 0.25
            WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN d.status = 'needs_review' AND d.source_channel = 'upload' ELSE true END
        JOIN (VALUES (0, 0, 'assign'), (0, 1, 'create_notification'), (1, 0, 'transition'), (2, 0, 'send_template_email'),
          (3, 0, 'assign'), (3, 1, 'transition'), (4, 0, 'webhook_post'), (4, 1, 'unknown')) a(kind, pos, action_type) ON a.kind = r.id % 5""",
    "assigned": """SELECT m.*, CASE WHEN kind = 0 THEN w.owner_id ELSE 'u5' END AS new_assignee,
        CASE WHEN m.status IN ('needs_review', 'acknowledged') THEN 'assigned' END AS new_status
        FROM matches m JOIN workspaces w ON w.id = m.workspace_id
        WHERE action_type = 'assign' AND (kind = 3 OR coalesce(trim(assigned_to), '') = '')""",
    "moved": f"""SELECT m.*, e.target AS new_status, CASE WHEN kind = 1 THEN 'noted' END AS new_notes FROM matches m
        JOIN {EDGES} ON e.source = m.status AND e.target = CASE WHEN kind = 1 THEN 'acknowledged' ELSE 'approved' END
        WHERE action_type = 'transition'""",
    "hinted": """SELECT d.workspace_id AS ws, arg_min(t.id, t.name) AS template_id, min(t.name) AS template_name, arg_min(t.p_brand, t.name) AS p_brand
        FROM (SELECT DISTINCT workspace_id FROM doc_ledger) d JOIN templates t ON (t.workspace_id IS NULL OR t.workspace_id = d.workspace_id)
        AND contains(lower(t.name), 'status update') GROUP BY d.workspace_id""",
    "mailed": """SELECT l.id AS document_id, l.workspace_id, m.rule_id, m.rule_name, m.pos, l.to_email, h.template_id, h.template_name || ' - ' || l.filename AS subject,
        l.letter || h.p_brand AS body FROM matches m JOIN letters l ON l.id = m.id JOIN hinted h ON h.ws = l.workspace_id
        WHERE m.action_type = 'send_template_email' AND l.to_email IS NOT NULL""",
    "requests": """SELECT event_id, user_id, event_type AS path, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 10 AS latency, ts FROM events""",
    "listing": f"""SELECT 'src' || (doc_id // 2 % 3) AS connector_type, 'x' || (doc_id // 2) AS external_id, doc_id AS position,
        CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'doc_' || doc_id || {pick(('.txt', '.json', '.exe', '.MD', '.csv'), 'doc_id % 5')} END AS filename,
        CASE WHEN doc_id % 17 = 0 THEN 'video/mp4' ELSE 'text/plain' END AS content_type,
        CASE WHEN doc_id % 19 = 0 THEN 0 ELSE n_chars * 20000 END AS length FROM documents""",
    "checked": """SELECT *, CASE WHEN trim(filename) = '' THEN 'File name is required.' WHEN length = 0 THEN 'Uploaded file is empty.'
        WHEN length > 26214400 THEN 'File too large. Maximum allowed size is 26214400 bytes.'
        WHEN filename LIKE '%.exe' THEN 'File extension is not allowed. Allowed: csv, docm, docx, jpeg, jpg, json, md, pdf, png, tif, tiff, txt'
        WHEN content_type LIKE 'video/%' THEN 'Unsupported content type.' END AS reject_reason FROM listing""",
    "sync_ledger": """SELECT 'src' || (doc_id // 2 % 3) AS connector_type, 'x' || (doc_id // 2) AS external_id FROM labels WHERE quality = 0""",
    "outcomes": """SELECT c.*, CASE WHEN s.external_id IS NOT NULL THEN 'skipped' WHEN c.position = f.first THEN 'imported'
        WHEN c.position > f.first THEN 'skipped' ELSE 'failed' END AS outcome
        FROM checked c LEFT JOIN (SELECT DISTINCT * FROM sync_ledger) s USING (connector_type, external_id)
        LEFT JOIN (SELECT c2.connector_type, c2.external_id, min(c2.position) AS first FROM checked c2 WHERE c2.reject_reason IS NULL
          GROUP BY ALL) f USING (connector_type, external_id)""",
    "sub_events": f"""SELECT l_orderkey || '-' || (l_linenumber % 5) AS event_id, l_linenumber AS sequence, l_orderkey AS subscription_id,
        {pick(('updated', 'checkout', 'paid', 'failed', 'deleted', 'other'), '(l_partkey + l_linenumber) % 6')} AS kind,
        {pick(('customer.subscription.updated', 'checkout.session.completed', 'invoice.paid', 'invoice.payment_failed', 'customer.subscription.deleted', 'charge.other'),
              '(l_partkey + l_linenumber) % 6')} AS event_type, {pick(('active', 'past_due', 'canceled', 'unpaid', 'odd'), 'l_suppkey % 5')} AS provider_status,
        {pick(('active', 'past_due', 'canceled', 'past_due', 'active'), 'l_suppkey % 5')} AS mapped,
        CASE WHEN l_suppkey % 2 = 0 THEN 'enterprise' END AS plan_tier,
        CASE WHEN l_quantity > 10 THEN l_shipdate + INTERVAL 30 DAY END AS period_end, l_shipdate AS created_at FROM lineitem""",
}

def sql(body: str) -> str:
    """The body preceded by the derived tables it mentions."""
    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+\(?{name}\b", text):
                wanted.add(name)
                add(VIEWS[name])

    add(body)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and other in wanted and re.search(rf"\b(FROM|JOIN)\s+\(?{other}\b", VIEWS[name]):
                place(other)
        order.append(name)

    for name in VIEWS:
        if name in wanted:
            place(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH {head}\n{body}" if head else body
