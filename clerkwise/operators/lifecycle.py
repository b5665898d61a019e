"""Status changes, assignment, review and bulk actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.codec import overlay
from clerkwise.functions.predicates import TO_ASSIGN, empty, transition_allowed, unassigned_to_triage
from clerkwise.operators.listing import triage_order
from clerkwise.operators.rules import Rule, as_rules, lookup

DEFAULT_ASSIGNEE = "triage_queue"


def apply_transitions(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each request (document_id, to_status, notes).

    ``applied`` rows carry the new status and notes; a row with an edge that
    does not exist, or an unknown document, carries an error.
    """
    joined = _with_documents(docs, requests, ["status", "reviewer_notes"])
    found = F.col("__found")
    ok = found & transition_allowed(F.col("status"), F.col("to_status"))
    error = (
        F.when(~found, F.lit("not found"))
        .when(~ok, F.concat(F.lit("Cannot transition from '"), F.col("status"), F.lit("' to '"),
                            F.coalesce(F.col("to_status"), F.lit("")), F.lit("'")))
    )
    notes = F.when(ok & ~empty(F.col("notes")), F.col("notes")).otherwise(F.col("reviewer_notes"))
    return joined.select(
        "document_id", F.col("status").alias("from_status"), "to_status", ok.alias("applied"),
        F.when(ok, F.col("to_status")).otherwise(F.col("status")).alias("status"),
        notes.alias("reviewer_notes"), error.alias("error"))


def transition_audit(outcomes: DataFrame, actor: str, as_of: Column) -> DataFrame:
    return outcomes.filter("applied").select(
        "document_id", F.lit("status_transition").alias("action"), F.lit(actor).alias("actor"),
        F.concat(F.lit("from="), F.col("from_status"), F.lit(" to="), F.col("to_status")).alias("details"),
        as_of.alias("created_at"))


def transition_notifications(outcomes: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    names = docs.select(F.col("id").alias("__id"), "filename", "workspace_id")
    moved = outcomes.filter("applied").join(names, F.col("document_id") == F.col("__id"), "inner")
    title = F.concat(F.col("filename"), F.lit(": "), F.col("from_status"), F.lit(" → "), F.col("to_status"))
    return moved.select(F.lit("status_change").alias("type"), title.alias("title"), F.lit("").alias("message"), "document_id",
                        "workspace_id", F.lit(False).alias("is_read"), as_of.alias("created_at"))


def _with_documents(docs: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    """Requests LEFT JOIN documents on the id, with a found flag."""
    side = docs.select(F.col("id").alias("__id"), *columns)
    joined = requests.join(side, F.col("document_id") == F.col("__id"), "left")
    return joined.withColumn("__found", F.col("__id").isNotNull())


def assigned_status(status: Column) -> Column:
    return F.when(status.isin(*TO_ASSIGN), F.lit("assigned")).otherwise(status)


def assign(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """New assignee and status per request (document_id, user_id)."""
    joined = _with_documents(docs, requests, ["status", "filename", "doc_type"])
    return joined.filter("__found").select(
        "document_id", F.col("user_id").alias("assigned_to"),
        F.col("status").alias("from_status"), assigned_status(F.col("status")).alias("status"),
        "filename", "doc_type")


def assignment_audit(changed: DataFrame, actor: str, as_of: Column, action: str = "assigned") -> DataFrame:
    return changed.select(
        "document_id", F.lit(action).alias("action"), F.lit(actor).alias("actor"),
        F.concat(F.lit("assigned_to="), F.col("assigned_to")).alias("details"), as_of.alias("created_at"))


def assignment_notifications(changed: DataFrame, as_of: Column) -> DataFrame:
    return changed.select(
        F.col("assigned_to").alias("user_id"), F.lit("assignment").alias("type"),
        F.concat(F.lit("Document assigned to you: "), F.col("filename")).alias("title"),
        F.concat(F.lit("Type: "), F.coalesce(F.col("doc_type"), F.lit("None"))).alias("message"),
        "document_id", F.lit(False).alias("is_read"), as_of.alias("created_at"))


def auto_assignment_notifications(changed: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    names = docs.select(F.col("id").alias("__id"), "filename", "workspace_id")
    told = changed.join(names, F.col("document_id") == F.col("__id"), "inner")
    return told.select(
        F.col("assigned_to").alias("user_id"), F.lit("assignment").alias("type"),
        F.concat(F.lit("Document assigned: "), F.coalesce("filename", F.lit("document"))).alias("title"),
        F.lit("Auto-assigned by the automation run.").alias("message"), "document_id", "workspace_id",
        F.lit(False).alias("is_read"), as_of.alias("created_at"))


def auto_assign(docs: DataFrame, user: str = DEFAULT_ASSIGNEE, limit: int | None = None) -> DataFrame:
    """The first ``limit`` unassigned documents in queue order, or all of them, go to ``user``."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    queue = docs.filter(unassigned_to_triage())
    chosen = queue if limit is None else triage_order(queue).limit(limit)
    return chosen.select(
        F.col("id").alias("document_id"), F.lit(user).alias("assigned_to"),
        F.col("status").alias("from_status"), assigned_status(F.col("status")).alias("status"))


def auto_assign_counts(docs: DataFrame, limit: int) -> DataFrame:
    waiting = F.count_if(unassigned_to_triage())
    return docs.agg(waiting.alias("__n")).select(
        F.least(F.col("__n"), F.lit(limit)).cast("long").alias("assigned_count"),
        F.greatest(F.col("__n") - limit, F.lit(0)).cast("long").alias("remaining_unassigned"))


def review(docs: DataFrame, reviews: DataFrame, rules: DataFrame | list[Rule]) -> DataFrame:
    """Changed columns per review.

    Reviews: document_id, approve, notes, corrected_doc_type,
    corrected_department, corrected_fields (map). The edge table is not checked.
    """
    rules = as_rules(rules)
    joined = _with_documents(
        docs, reviews,
        ["status", "doc_type", "department", "extracted_fields", "missing_fields", "validation_errors"],
    ).filter("__found")
    nothing = F.from_json(F.lit("{}"), "map<string,string>")
    fixes = F.coalesce(F.col("corrected_fields"), nothing)
    own = F.coalesce(F.col("extracted_fields"), nothing)
    approve = F.col("approve")
    kind = F.coalesce(F.nullif(F.col("corrected_doc_type"), F.lit("")), F.col("doc_type"))
    joined = joined.withColumn("__kind", kind)
    kind = F.col("__kind")
    routed = lookup(rules, "__kind", "department")
    department = F.coalesce(F.nullif(F.col("corrected_department"), F.lit("")), routed)
    corrected = ~empty(F.col("corrected_doc_type")) | (F.size(fixes) > 0)
    none = F.array().cast("array<string>")

    def when(yes: Column, no: Column) -> Column:
        return F.when(approve, yes).otherwise(no)

    return joined.select(
        "document_id",
        when(F.when(corrected, "corrected").otherwise("approved"), F.lit("needs_review")).alias("status"),
        when(kind, F.col("doc_type")).alias("doc_type"),
        when(department, F.col("department")).alias("department"),
        when(overlay(own, fixes), own).alias("extracted_fields"),
        when(none, F.col("missing_fields")).alias("missing_fields"),
        when(none, F.col("validation_errors")).alias("validation_errors"),
        (~approve).alias("requires_review"),
        F.col("notes").alias("reviewer_notes"))


def review_audit(reviews: DataFrame, rules: DataFrame | list[Rule], actor: str, as_of: Column) -> DataFrame:
    """One audit row per review with the decision and the types known that day."""
    known = ",".join(sorted(r.doc_type for r in as_rules(rules)))
    details = F.concat(
        F.lit("approve="), F.initcap(F.col("approve").cast("string")), F.lit(" corrected_doc_type="),
        F.coalesce("corrected_doc_type", F.lit("None")), F.lit(f" allowed_types={known}"))
    return reviews.select("document_id", F.lit("reviewed").alias("action"), F.lit(actor).alias("actor"),
                          details.alias("details"), as_of.alias("created_at"))


def bulk(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per request (document_id, action, user_id, to_status).

    approve takes any status, transition only an allowed edge; every failure is
    an error of its own row.
    """
    joined = _with_documents(docs, requests, ["status", "assigned_to", "requires_review"])
    action, status, target = F.col("action"), F.col("status"), F.col("to_status")
    error = (
        F.when(~F.col("__found"), F.lit("not found"))
        .when(~action.isin("approve", "assign", "transition"),
              F.concat(F.lit("unknown action '"), action, F.lit("'")))
        .when((action == "assign") & empty(F.col("user_id")), F.lit("user_id required for assign"))
        .when((action == "transition") & empty(target), F.lit("status required for transition"))
        .when((action == "transition") & ~transition_allowed(status, target),
              F.concat(F.lit("invalid transition "), status, F.lit(" → "), target))
    )
    done = error.isNull()
    new_status = (
        F.when(~done, status)
        .when(action == "approve", F.lit("approved"))
        .when(action == "assign", assigned_status(status))
        .otherwise(target)
    )
    return joined.select(
        "document_id", "action", F.when(done, "ok").otherwise("error").alias("outcome"),
        F.concat(F.col("document_id").cast("string"), F.lit(": "), error).alias("error"),
        new_status.alias("status"),
        F.when(done & (action == "assign"), F.col("user_id")).otherwise(F.col("assigned_to")).alias("assigned_to"),
        F.when(done & (action == "approve"), F.lit(False)).otherwise(F.col("requires_review")).alias("requires_review"))


def bulk_audit(outcomes: DataFrame, actor: str, as_of: Column) -> DataFrame:
    """Audit rows of the bulk requests that took effect."""
    kind = F.col("action")
    name = (F.when(kind == "approve", "bulk_approved").when(kind == "assign", "bulk_assigned").otherwise("bulk_transition"))
    details = (F.when(kind == "assign", F.concat(F.lit("assigned_to="), F.col("assigned_to")))
               .when(kind == "transition", F.concat(F.lit("to="), F.col("status"))))
    return outcomes.filter("outcome = 'ok'").select(
        "document_id", name.alias("action"), F.lit(actor).alias("actor"), details.alias("details"), as_of.alias("created_at"))


def bulk_errors(outcomes: DataFrame, limit: int) -> DataFrame:
    """The errors a bulk report shows."""
    return outcomes.filter("outcome = 'error'").select("document_id", "action", "error").orderBy("document_id", "action", "error").limit(limit)


def bulk_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("outcome") == "ok").alias("success_count"),
                        F.count_if(F.col("outcome") == "error").alias("error_count"))


def mark_read(notifications: DataFrame, visible: Column, as_of: Column,
              ids: DataFrame | None = None) -> DataFrame:
    """Notifications after reading: every unread visible row, or the given ids."""
    if ids is None:
        hit = visible & ~F.col("is_read")
        source = notifications
    else:
        chosen = ids.select(F.col("id").alias("__id")).distinct()
        source = notifications.join(chosen, F.col("id") == F.col("__id"), "left")
        hit = visible & F.col("__id").isNotNull()
    hit = F.coalesce(hit, F.lit(False))
    return source.select(
        *[c for c in notifications.columns if c not in ("is_read", "read_at")],
        (F.col("is_read") | hit).alias("is_read"),
        F.when(hit, as_of).otherwise(F.col("read_at")).alias("read_at"),
        hit.alias("changed"))


def retry_jobs(failures: DataFrame, as_of: Column) -> DataFrame:
    """Next state of failed jobs: queued again while attempts remain, else dead."""
    again = F.col("attempts") < F.col("max_attempts")
    return failures.withColumns({
        "status": F.when(again, "queued").otherwise("failed"),
        "finished_at": F.when(~again, as_of),
        "started_at": F.when(again, F.lit(None).cast("timestamp")).otherwise(F.col("started_at")),
    })
