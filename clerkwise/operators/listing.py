"""List views: filters, orders and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.dates import age_label, days_overdue
from clerkwise.functions.predicates import (
    blank, in_workspace, in_workspace_or_global, is_overdue, unassigned_to_triage, visible_to)

# Statuses of the reply sweep in the order they use up its budget.
SWEEP_STATUSES = ("needs_review", "assigned", "acknowledged")


def scope(df: DataFrame, workspace_id: str | None) -> DataFrame:
    return df.filter(in_workspace(workspace_id))


def scope_or_global(df: DataFrame, workspace_id: str | None) -> DataFrame:
    return df.filter(in_workspace_or_global(workspace_id))


def light(df: DataFrame) -> DataFrame:
    """List views carry no text, so the scan never reads that column."""
    return df.drop("extracted_text")


def list_documents(docs: DataFrame, as_of: Column, status: str | None = None,
                   department: str | None = None, assigned_to: str | None = None,
                   workspace_id: str | None = None, *, limit: int) -> DataFrame:
    """Newest documents under ANDed filters; status ``overdue`` is computed."""
    out = scope(light(docs), workspace_id)
    if status:
        out = out.filter(is_overdue(as_of) if status == "overdue" else F.col("status") == status)
    if department:
        out = out.filter(F.col("department") == department)
    if assigned_to:
        out = out.filter(F.col("assigned_to") == assigned_to)
    return newest(out, limit)


def newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(limit)


def overdue(docs: DataFrame, as_of: Column, limit: int | None = None,
            workspace_id: str | None = None) -> DataFrame:
    """Overdue documents with whole days late; with a limit the oldest due first."""
    out = scope(light(docs), workspace_id).filter(is_overdue(as_of)).withColumn(
        "days_overdue", days_overdue(F.col("due_date"), as_of))
    return out if limit is None else out.orderBy("due_date", "id").limit(limit)


def triage_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("due_date").asc_nulls_last(), F.col("updated_at").desc_nulls_last(), "id")


def unassigned_queue(docs: DataFrame, limit: int, workspace_id: str | None = None) -> DataFrame:
    return triage_order(scope(light(docs), workspace_id).filter(unassigned_to_triage())).limit(limit)


def priority_columns(as_of: Column) -> list[Column]:
    urgent = F.coalesce(F.col("urgency") == "high", F.lit(False))
    flagged = F.coalesce(F.col("requires_review"), F.lit(False))
    return [urgent.desc(), is_overdue(as_of).desc(), flagged.desc(),
            F.col("updated_at").desc_nulls_last(), F.col("id").asc()]


def priority_order(docs: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Urgent, then overdue, then flagged, then newest."""
    out = light(docs).orderBy(*priority_columns(as_of))
    return out if limit is None else out.limit(limit)


def urgent_view(docs: DataFrame) -> DataFrame:
    return light(docs).filter(F.col("urgency") == "high")


def unassigned_view(docs: DataFrame) -> DataFrame:
    return light(docs).filter(blank(F.col("assigned_to")))


def search_filename(docs: DataFrame, needle: str) -> DataFrame:
    wanted = needle.strip().lower()
    out = light(docs)
    return out.filter(F.contains(F.lower("filename"), F.lit(wanted))) if wanted else out


def review_shortlist(docs: DataFrame, limit: int) -> DataFrame:
    """First documents to look at: flagged or in needs_review, newest first."""
    wanted = F.col("requires_review") | (F.col("status") == "needs_review")
    return newest(light(docs).filter(wanted), limit)


def sweep_candidates(docs: DataFrame, limit: int, include_failed: bool = False) -> DataFrame:
    """Fill the budget status by status, newest first within a status."""
    statuses = SWEEP_STATUSES + (("failed",) if include_failed else ())
    rank = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    return light(docs).filter(F.col("status").isin(*statuses)).orderBy(
        rank, F.col("updated_at").desc_nulls_last(), "id").limit(limit)


def with_age(docs: DataFrame, as_of: Column) -> DataFrame:
    return docs.withColumn("age", age_label(F.col("updated_at"), as_of))


def audit_page(audit: DataFrame, docs: DataFrame, limit: int, offset: int = 0,
               action: str | None = None, actor: str | None = None,
               document_id: str | None = None, before_id=None) -> DataFrame:
    """One page of the audit log with file names. The page is cut before the
    join, so the join sees ``limit`` rows.

    Pages by ``before_id``, the last id of the page before, cost the same at any
    depth: a pushed filter and a top-k. An ``offset`` is found by counting ranges of ids (``page_by_ranges``).
    """
    rows = _audit_filter(audit, action, actor, document_id)
    if before_id is not None:
        rows = rows.filter(F.col("id") < F.lit(before_id))
    page = page_by_ranges(rows, "id", limit, offset) if offset else rows.orderBy(F.col("id").desc()).limit(limit)
    return with_filename(page, docs)


RANGES = 1024
RANGE_ROWS = 50_000


def page_by_ranges(rows: DataFrame, column: str, limit: int, offset: int, enough: int = RANGE_ROWS) -> DataFrame:
    """``limit`` rows after the first ``offset`` in descending order of a whole-number ``column`` without nulls, at any depth.

    The values of the page's first and last row are found by counting rows in up to 1024 ranges, then in finer ranges of the one that
    holds the row, until it has at most ``enough`` rows. What is sorted in the end lies between the two values, by a filter that
    reaches the scan. Each count is one pass over the column with a small aggregate, at most seven for either row; the driver gets 1024 numbers.
    """
    first, last = rows.agg(F.min(column), F.max(column)).first()
    top = None if first is None or limit < 1 else _value_at(rows, column, offset, first, last, enough)
    if top is None:
        return rows.limit(0)
    high, before = top
    end = _value_at(rows, column, offset + limit - 1, first, high, enough, before)
    low = first if end is None else end[0]
    return rows.filter(F.col(column).between(low, high)).orderBy(F.col(column).desc()).offset(offset - before).limit(limit)


def _value_at(rows: DataFrame, column: str, place: int, first: int, last: int, enough: int, before: int = 0) -> tuple[int, int] | None:
    """The value of the row at ``place`` (from 0) in descending order, and how many rows have greater values. It lies between ``first`` and
    ``last``, above which there are ``before`` rows. None if there are fewer rows."""
    key = F.col(column)
    while True:
        width = max(1, -(-(last - first + 1) // RANGES))
        inside = rows.filter(key.between(first, last))
        counts = {r["part"]: r["n"] for r in inside.groupBy(F.expr(f"({last} - `{column}`) div {width}").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for part in sorted(counts):
            if place < before + counts[part]:
                break
            before += counts[part]
        else:
            return None
        first, last = max(first, last - (part + 1) * width + 1), last - part * width
        if width == 1:
            return last, before
        if counts[part] <= enough:
            held = rows.filter(key.between(first, last))
            value = held.orderBy(key.desc()).offset(place - before).limit(1).first()[0]
            return value, before + held.filter(key > value).count()


def _audit_filter(audit: DataFrame, action=None, actor=None, document_id=None) -> DataFrame:
    for column, value in (("action", action), ("actor", actor), ("document_id", document_id)):
        if value:
            audit = audit.filter(F.col(column) == F.lit(value))
    return audit


def audit_total(audit: DataFrame, **filters) -> DataFrame:
    return _audit_filter(audit, **filters).agg(F.count(F.lit(1)).alias("total"))


def activity_feed(audit: DataFrame, docs: DataFrame, limit: int,
                  workspace_id: str | None = None) -> DataFrame:
    """Newest audit events with the file name of their document."""
    recent = scope(audit, workspace_id).orderBy(F.col("id").desc()).limit(limit)
    return with_filename(recent, docs)


def with_filename(audit: DataFrame, docs: DataFrame) -> DataFrame:
    names = docs.select(F.col("id").alias("__doc"), "filename")
    return audit.join(names, F.col("document_id") == F.col("__doc"), "left").drop("__doc")


def document_trail(audit: DataFrame, document_id, limit: int) -> DataFrame:
    return audit.filter(F.col("document_id") == F.lit(document_id)).orderBy(F.col("id").desc()).limit(limit)


def notifications_for(notifications: DataFrame, user_id: str | None, workspace_id: str | None = None,
                      unread_only: bool = False, *, limit: int) -> DataFrame:
    out = scope(notifications.filter(visible_to(user_id)), workspace_id)
    if unread_only:
        out = out.filter(~F.col("is_read"))
    return out.orderBy(F.col("id").desc()).limit(limit)


def by_status(df: DataFrame, status: str | None, limit: int) -> DataFrame:
    """Jobs, keys, deployments or invitations of one status, newest id first."""
    out = df.filter(F.col("status") == status) if status else df
    return out.orderBy(F.col("id").desc()).limit(limit)


def invitation_state(invitations: DataFrame, as_of: Column) -> DataFrame:
    """Valid while pending and not expired; otherwise the reason it is refused."""
    reason = (
        F.when(F.col("status") != "pending", F.lit("Invitation has already been used or revoked."))
        .when(F.col("expires_at") < as_of, F.lit("Invitation has expired."))
    )
    return invitations.withColumns({"valid": reason.isNull(), "reason": reason})
