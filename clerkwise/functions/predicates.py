"""Status lists and boolean expressions shared by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status groups. They differ on purpose and must not be unified.
DONE = ("approved", "corrected", "completed", "archived")
READY = ("routed", "approved", "corrected", "acknowledged", "assigned", "in_progress", "completed")
ROUTED_OR_APPROVED = ("routed", "approved", "corrected")
AUTOMATED = ("routed", "approved", "corrected", "completed", "archived")
OPEN = ("ingested", "needs_review", "acknowledged", "assigned", "in_progress", "failed")
TO_ASSIGN = ("needs_review", "acknowledged")
APPROVED = ("approved", "corrected")

# Allowed status edges.
TRANSITIONS = {
    "ingested": ["needs_review", "routed"],
    "needs_review": ["acknowledged", "approved", "corrected"],
    "routed": ["acknowledged", "approved"],
    "acknowledged": ["assigned", "approved", "in_progress"],
    "assigned": ["in_progress", "approved"],
    "in_progress": ["completed", "approved"],
    "completed": ["archived"],
    "approved": ["archived"],
    "corrected": ["archived"],
    "failed": ["needs_review", "ingested"],
}


def blank(col: Column) -> Column:
    """Null or only spaces (SQL TRIM)."""
    return col.isNull() | (F.trim(col) == "")


def empty(col: Column) -> Column:
    """Null or the empty string."""
    return col.isNull() | (col == "")


def is_overdue(as_of: Column, due: str = "due_date", status: str = "status") -> Column:
    late = F.col(due).isNotNull() & (F.col(due) < as_of)
    return F.coalesce(late & ~F.col(status).isin(*DONE), F.lit(False))


def unassigned_to_triage() -> Column:
    return F.col("status").isin(*TO_ASSIGN) & blank(F.col("assigned_to"))


def unassigned_open() -> Column:
    return F.col("status").isin(*OPEN) & blank(F.col("assigned_to"))


def in_workspace(workspace_id: str | None, col: str = "workspace_id") -> Column:
    """Equality scope; no scope given means every row."""
    return F.lit(True) if workspace_id is None else F.col(col) == F.lit(workspace_id)


def in_workspace_or_global(workspace_id: str | None, col: str = "workspace_id") -> Column:
    """Rows of the workspace plus the global ones; only global without a workspace."""
    if workspace_id is None:
        return F.col(col).isNull()
    return (F.col(col) == F.lit(workspace_id)) | F.col(col).isNull()


def visible_to(user_id: str | None, col: str = "user_id") -> Column:
    """Rows addressed to the user or to everybody."""
    if not user_id:
        return F.lit(True)
    return (F.col(col) == F.lit(user_id)) | F.col(col).isNull()


def transition_allowed(current: Column, target: Column) -> Column:
    """Edge test against the fixed table: a literal map, so no join is needed."""
    edges = F.create_map(*[
        part
        for source, targets in TRANSITIONS.items()
        for part in (F.lit(source), F.array(*[F.lit(t) for t in targets]))
    ])
    return F.coalesce(F.array_contains(F.try_element_at(edges, current), target), F.lit(False))
