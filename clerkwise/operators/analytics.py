"""Queue, totals, health and request metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.predicates import (
    AUTOMATED, OPEN, READY, ROUTED_OR_APPROVED, in_workspace, is_overdue, unassigned_open,
    unassigned_to_triage, visible_to)
from clerkwise.functions.rendering import has_contact

# Latency bucket bounds in seconds.
LATENCY_BOUNDS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


def queue_snapshot(docs: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Total, needs_review (by status) and ready documents per department."""
    return (
        docs.filter(in_workspace(workspace_id))
        .groupBy(F.coalesce("department", F.lit("Unassigned")).alias("department"))
        .agg(F.count(F.lit(1)).alias("total"),
             F.count_if(F.col("status") == "needs_review").alias("needs_review"),
             F.count_if(F.col("status").isin(*READY)).alias("ready"))
        .orderBy(F.col("total").desc(), "department")
    )


def queue_totals(snapshot: DataFrame) -> DataFrame:
    """Grand totals over a queue snapshot."""
    return snapshot.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "needs_review", "ready")])


def analytics_totals(docs: DataFrame, emails: DataFrame, as_of: Column,
                     workspace_id: str | None = None) -> DataFrame:
    """All headline figures in one pass over each table."""
    status = F.col("status")
    figures = docs.filter(in_workspace(workspace_id)).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("requires_review")).alias("needs_review"),
        F.count_if(status.isin(*ROUTED_OR_APPROVED)).alias("routed_or_approved"),
        F.count_if(status.isin(*AUTOMATED)).alias("automated_documents"),
        F.coalesce(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 4), F.lit(0.0)).alias("average_confidence"),
        F.count_if(unassigned_open()).alias("manual_unassigned"),
        F.count_if(status.isin(*OPEN) & ~F.coalesce(has_contact(F.col("extracted_fields")), F.lit(False)))
        .alias("missing_contact_email"),
        F.count_if(is_overdue(as_of)).alias("overdue"),
    )
    mails = emails.filter(in_workspace(workspace_id)).agg(emails_sent_since(as_of).alias("emails_sent_today"))
    # Two single rows become one without a cross join.
    both = figures.unionByName(mails, allowMissingColumns=True)
    total = both.agg(*[F.max(c).alias(c) for c in both.columns])
    manual = F.greatest(F.col("total_documents") - F.col("automated_documents"), F.lit(0))
    total = total.withColumn("manual_documents", manual)

    def rate(col: str) -> Column:
        share = F.col(col) / F.nullif(F.col("total_documents"), F.lit(0))
        return F.coalesce(F.round(share, 4), F.lit(0.0))

    return total.withColumns({"automation_rate": rate("automated_documents"),
                              "manual_rate": rate("manual_documents")})


def emails_sent_since(as_of: Column) -> Column:
    return F.count_if((F.col("status") == "sent") & (F.col("sent_at") >= F.date_trunc("day", as_of)))


def counts_by(docs: DataFrame, col: str, null_label: str | None = None,
              workspace_id: str | None = None) -> DataFrame:
    label = F.col(col) if null_label is None else F.coalesce(F.col(col), F.lit(null_label))
    return (
        docs.filter(in_workspace(workspace_id)).groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "label")
    )


def overdue_count(docs: DataFrame, as_of: Column, workspace_id: str | None = None) -> DataFrame:
    return docs.filter(in_workspace(workspace_id)).agg(F.count_if(is_overdue(as_of)).alias("total"))


def triage_count(docs: DataFrame, workspace_id: str | None = None) -> DataFrame:
    return docs.filter(in_workspace(workspace_id)).agg(F.count_if(unassigned_to_triage()).alias("total"))


def missing_contact(docs: DataFrame, keys: list[str]) -> DataFrame:
    gone = F.col("status").isin(*OPEN) & ~F.coalesce(has_contact(F.col("extracted_fields")), F.lit(False))
    return docs.groupBy(*keys).agg(F.count_if(gone).alias("missing_contact_email"))


def manual_unassigned(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count_if(unassigned_open()).alias("manual_unassigned"))


def unread_count(notifications: DataFrame, user_id: str | None, workspace_id: str | None = None) -> DataFrame:
    return notifications.filter(visible_to(user_id) & in_workspace(workspace_id)).agg(
        F.count_if(~F.col("is_read")).alias("total"))


def system_health(jobs: DataFrame, docs: DataFrame, audit: DataFrame, emails: DataFrame,
                  as_of: Column, error_pattern: str = "failed") -> DataFrame:
    """Health figures of the last 24 hours as (metric, value) rows: one
    aggregate per table, the single rows stacked."""
    since = as_of - F.make_dt_interval(F.lit(1))
    status = F.lower(F.trim(F.col("status")))
    queue = jobs.agg(
        F.count_if(status == "queued").alias("jobs_queued"),
        F.count_if(status.isin("running", "in_progress")).alias("jobs_running"),
        F.count_if(status == "failed").alias("jobs_failed"))
    recent = docs.filter(F.col("created_at") >= since).agg(
        F.count(F.lit(1)).alias("documents_total"),
        F.count_if(F.col("status").isin(*AUTOMATED) & ~F.col("requires_review")).alias("documents_auto_routed"),
        F.count_if(F.col("requires_review") | (F.col("status") == "needs_review")).alias("documents_needs_review"),
        F.count_if(F.col("status") == "failed").alias("documents_failed"))
    errors = audit.filter(F.col("created_at") >= since).agg(
        F.count_if(F.contains(F.lower("action"), F.lit(error_pattern))).alias("audit_errors"))
    mail = emails.filter(F.col("created_at") >= since).agg(
        F.count_if(status == "sent").alias("emails_sent"),
        F.count_if(status == "failed").alias("emails_failed"))
    rows = [_long(t) for t in (queue, recent, errors, mail)]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def _long(single: DataFrame) -> DataFrame:
    """A single row of figures as (metric, value) rows."""
    return single.unpivot([], single.columns, "metric", "value")


def latency_histogram(requests: DataFrame, keys: list[str], latency: str = "latency",
                      bounds: Iterable[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts per bucket bound, +Inf included."""
    value = F.greatest(F.col(latency), F.lit(0.0))
    labels = [(bound, repr(float(bound))) for bound in bounds]
    per_key = requests.groupBy(*keys).agg(
        *[F.count_if(value <= bound).alias(f"le {text}") for bound, text in labels],
        F.count(F.lit(1)).alias("le +Inf"))
    long = per_key.unpivot(keys, [f"`{c}`" for c in per_key.columns if c not in keys], "le", "cumulative_count")
    return long.withColumn("le", F.substring_index("le", " ", -1))


def request_counter(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))


def platform_counts(api_keys: DataFrame, invitations: DataFrame, workspace_id: str | None = None) -> DataFrame:
    keys = api_keys.agg(F.count_if(F.col("status") == "active").alias("active_api_keys"))
    invited = invitations.filter(in_workspace(workspace_id)).agg(
        F.count_if(F.col("status") == "pending").alias("pending_invitations"))
    return _long(keys).unionByName(_long(invited))
