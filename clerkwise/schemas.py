"""Table schemas of the intake data model (Spark form)."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "documents": """
        id string, workspace_id string, filename string, storage_path string,
        source_channel string, content_type string, status string, doc_type string,
        department string, urgency string, confidence double, requires_review boolean,
        extracted_text string, extracted_fields map<string,string>,
        missing_fields array<string>, validation_errors array<string>,
        reviewer_notes string, created_at timestamp, updated_at timestamp,
        due_date timestamp, sla_days int, assigned_to string""",
    "audit_events": """
        id long, workspace_id string, document_id string, action string, actor string,
        details string, created_at timestamp""",
    "notifications": """
        id long, workspace_id string, user_id string, type string, title string,
        message string, document_id string, is_read boolean, created_at timestamp,
        read_at timestamp""",
    "jobs": """
        id string, workspace_id string, job_type string, payload string, result string,
        status string, error string, actor string, attempts int, max_attempts int,
        worker_id string, created_at timestamp, started_at timestamp,
        finished_at timestamp""",
    "outbound_emails": """
        id string, workspace_id string, document_id string, to_email string,
        subject string, body string, status string, error string,
        created_at timestamp, sent_at timestamp""",
    "templates": """
        id long, workspace_id string, name string, doc_type string,
        template_body string, created_at timestamp, updated_at timestamp""",
    "workflow_rules": """
        id long, workspace_id string, name string, enabled boolean,
        trigger_event string, filters_json string, actions_json string,
        created_at timestamp, updated_at timestamp""",
    "connector_configs": """
        id long, workspace_id string, connector_type string, config_json string,
        enabled boolean, last_sync_at timestamp, created_at timestamp,
        updated_at timestamp""",
    "connector_sync_log": """
        id long, connector_type string, external_id string, filename string,
        document_id string, metadata_json string, created_at timestamp""",
    "watched_files": """
        id long, filename string, file_hash string, source_path string,
        document_id string, created_at timestamp""",
    "users": """
        id string, email string, full_name string, role string, status string,
        plan_tier string, stripe_customer_id string, email_preferences string,
        created_at timestamp, updated_at timestamp""",
    "workspaces": """
        id string, name string, slug string, owner_id string, plan_tier string,
        stripe_customer_id string, settings string, created_at timestamp,
        updated_at timestamp""",
    "workspace_members": """
        id long, workspace_id string, user_id string, role string,
        joined_at timestamp""",
    "invitations": """
        id long, workspace_id string, email string, role string, status string,
        actor string, created_at timestamp, expires_at timestamp,
        accepted_at timestamp""",
    "subscriptions": """
        id long, workspace_id string, user_id string, plan_tier string,
        billing_type string, stripe_subscription_id string,
        stripe_customer_id string, status string, current_period_start timestamp,
        current_period_end timestamp, canceled_at timestamp, created_at timestamp,
        updated_at timestamp""",
    "payment_events": """
        id long, workspace_id string, user_id string, stripe_event_id string,
        event_type string, amount_cents long, currency string, plan_tier string,
        billing_type string, raw_payload string, created_at timestamp""",
    "api_keys": """
        id long, name string, key_hash string, status string, actor string,
        created_at timestamp, revoked_at timestamp""",
    "deployments": """
        id long, environment string, provider string, status string, actor string,
        notes string, details string, external_id string, created_at timestamp,
        finished_at timestamp""",
}

RULES = """doc_type string, rule_order int, keywords array<string>, department string,
           required_fields array<string>, sla_days int"""

EXTERNAL_DOCUMENT = """external_id string, filename string, content_type string,
                       download_url string, size_bytes long,
                       metadata map<string,string>"""

REPLY = """doc_type string, department string, urgency string, confidence double,
           matched_keywords array<string>, rationale string"""
