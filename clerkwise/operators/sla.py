"""Overdue scan and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.dates import iso_utc
from clerkwise.functions.predicates import empty
from clerkwise.operators.listing import overdue

# No second notice within a day; reassign after three whole days.
LOOKBACK_MINUTES = 24 * 60
ESCALATION_DAYS = 3


def recently_notified(notifications: DataFrame, as_of: Column,
                      minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Documents with an overdue notice inside the look-back."""
    since = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return notifications.filter((F.col("type") == "overdue") & (F.col("created_at") >= since)).select(
        F.col("document_id").alias("__notified")).distinct()


def sla_scan(docs: DataFrame, notifications: DataFrame, as_of: Column,
             limit: int | None = None) -> DataFrame:
    """Overdue documents that were not notified lately, with days late.

    ``limit`` bounds the scan before suppression; by default all are scanned.
    """
    late = overdue(docs, as_of, limit)
    return late.join(recently_notified(notifications, as_of), F.col("id") == F.col("__notified"), "left_anti")


def overdue_notifications(scanned: DataFrame, as_of: Column) -> DataFrame:
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit("Document"))
    return scanned.select(
        F.lit("overdue").alias("type"), F.concat(F.lit("Overdue: "), name).alias("title"),
        F.concat(F.lit("SLA due date passed ("), iso_utc(F.col("due_date")), F.lit("). "),
                 F.col("days_overdue").cast("string"), F.lit("d overdue.")).alias("message"),
        F.nullif("assigned_to", F.lit("")).alias("user_id"), F.col("id").alias("document_id"),
        "workspace_id", F.lit(False).alias("is_read"), as_of.alias("created_at"))


def escalate(scanned: DataFrame, fallback_user: str, as_of: Column,
             after_days: int = ESCALATION_DAYS) -> DataFrame:
    """Reassignments of long overdue documents to the fallback user, with the
    audit text. The assignee is the one before the workflow pass."""
    if not fallback_user:
        return scanned.limit(0).select(F.col("id").alias("document_id"))
    long_late = scanned.filter((F.col("days_overdue") >= after_days)
                               & (F.coalesce("assigned_to", F.lit("")) != fallback_user))
    former = F.when(empty(F.col("assigned_to")), F.lit("unassigned")).otherwise(F.col("assigned_to"))
    text = F.col("days_overdue").cast("string")
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit("Document"))
    return long_late.select(
        F.col("id").alias("document_id"), "workspace_id", F.lit(fallback_user).alias("assigned_to"),
        F.lit("auto_escalated").alias("action"), F.lit("system_escalation").alias("actor"),
        F.concat(F.lit("Reassigned from "), former, F.lit(f" to {fallback_user} ("), text, F.lit("d overdue)")).alias("details"),
        F.concat(F.lit("Escalated: "), name).alias("title"),
        F.concat(F.lit("Auto-reassigned after "), text, F.lit("d overdue.")).alias("message"),
        as_of.alias("created_at"))


def overdue_run(docs: DataFrame, notifications: DataFrame, rules: DataFrame, templates: DataFrame, workspaces: DataFrame,
                as_of: Column, fallback_user: str, after_days: int = ESCALATION_DAYS):
    """One scheduled run: notices of overdue documents, the effects of their ``document_overdue`` workflow
    pass, the escalations, and the documents with what the pass and then the escalations wrote."""
    from clerkwise.operators.changes import update_by_key
    from clerkwise.operators.workflows import after_pass, run_workflows

    scanned = sla_scan(docs, notifications, as_of)
    effects = run_workflows(scanned.drop("days_overdue"), rules, templates, workspaces, "document_overdue", as_of)
    escalated = escalate(scanned, fallback_user, as_of, after_days)
    written = after_pass(docs, effects, as_of)
    if fallback_user:
        written = update_by_key(written, escalated.select(F.col("document_id").alias("id"), "assigned_to"), "id", ["assigned_to"], as_of)
    return overdue_notifications(scanned, as_of), effects, escalated, written
