"""Outbox rows. Nothing is sent: delivery belongs to a mail service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.codec import wants_mail
from clerkwise.functions.dates import money
from clerkwise.operators.workflows import compose_mail, hint_wish, template_offers, with_template

# Template name hints, statuses that trigger a mail, and the
# document id of account mails.
ACKNOWLEDGMENT = "acknowledgment"
MISSING_INFO = "request for information"
STATUS_UPDATE = "status update"
NOTIFY_STATUSES = ("approved", "completed", "assigned", "in_progress")
ACCOUNT_DOCUMENT = "__account__"

# Wording of the user mails: (subject, body) with {placeholders}. The product
# name is a setting of the caller.
USER_MAILS = {
    "doc_assigned": (
        "{brand}: document assigned to you: {filename}",
        "Hi {name},\n\nA document is waiting for your review.\n\nFile: {filename}\nType: {doc_type}\n"
        "Department: {department}\n"),
    "doc_review_complete": (
        "{brand}: document {status}: {filename}",
        "Hi {name},\n\nA document assigned to you is now {status}.\n\nFile: {filename}\n"
        "Status: {status}\nDepartment: {department}\n"),
}
ACCOUNT_MAILS = {
    "account_welcome": ("Welcome to {brand}", "Hi {name},\n\nYour account on {brand} is ready.\n"),
    "account_plan_change": (
        "{brand}: your plan is now {plan}", "Your plan on {brand} has been upgraded to {plan}.\n"),
    "account_payment_receipt": (
        "{brand}: payment receipt ({amount})",
        "We received your payment of {amount} for the {plan} plan. Thank you.\n"),
    "account_invitation": (
        "You are invited to {brand}",
        "{inviter} invites you to {brand}.\n\nCreate your account here:\n{link}\n\nThe link is valid for 7 days.\n"),
}


def fill(pattern: str, values: dict[str, Column]) -> Column:
    """A pattern with {names} as one concatenation."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(pattern):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def auto_mail(docs: DataFrame, templates: DataFrame, as_of: Column) -> DataFrame:
    """Acknowledgment for every document, a request when fields are missing, and
    a status update for four statuses, each from its template.

    The template is the first by name that contains the hint, among those of the document's workspace and the global
    ones; a document without a workspace sees all. One pass: a document explodes into the mails it is due, and the
    templates, one for each hint and scope, are looked up.
    """
    due = F.array_compact(F.array(
        F.struct(F.lit("acknowledgment").alias("type"), F.lit(ACKNOWLEDGMENT).alias("hint")),
        F.when(F.size(F.coalesce("missing_fields", F.array().cast("array<string>"))) > 0,
               F.struct(F.lit("missing_info").alias("type"), F.lit(MISSING_INFO).alias("hint"))),
        F.when(F.col("status").isin(*NOTIFY_STATUSES),
               F.struct(F.lit("status_update").alias("type"), F.lit(STATUS_UPDATE).alias("hint")))))
    wanted = docs.withColumn("__due", F.explode(due))
    hints = wanted.sparkSession.createDataFrame([(hint_wish(h),) for h in (ACKNOWLEDGMENT, MISSING_INFO, STATUS_UPDATE)], "wish string")
    joined = with_template(wanted.withColumn("__wish", F.concat(F.lit("hint "), F.col("__due.hint"))), template_offers(hints, templates))
    mailed = compose_mail(joined)
    return mailed.select(
        F.col("id").alias("document_id"), F.col("__due.type").alias("email_type"), "workspace_id",
        "to_email", "subject", "body", F.lit("pending").alias("status"), as_of.alias("created_at"))


def display_name(full_name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(full_name, F.lit("")), F.substring_index(email, "@", 1))


def user_mail(events: DataFrame, docs: DataFrame, users: DataFrame, option: str, brand: str,
              as_of: Column) -> DataFrame:
    """Mails to the user of an event (document_id, user_id) who wants them."""
    d = docs.select(F.col("id").alias("__doc"), "workspace_id", "filename", "doc_type", "department", "status")
    u = users.select(F.col("id").alias("__user"), "email", "full_name", "email_preferences")
    joined = events.join(d, F.col("document_id") == F.col("__doc"), "inner").join(
        u, F.col("user_id") == F.col("__user"), "inner")
    joined = joined.filter(wants_mail(F.col("email_preferences"), option) & (F.coalesce("email", F.lit("")) != ""))
    values = {c: F.coalesce(c, F.lit("None")) for c in ("filename", "doc_type", "department", "status")}
    values |= {"brand": F.lit(brand), "name": display_name(F.col("full_name"), F.col("email"))}
    subject, body = USER_MAILS[option]
    return joined.select(
        "document_id", "workspace_id", F.col("email").alias("to_email"), fill(subject, values).alias("subject"),
        fill(body, values).alias("body"), F.lit("pending").alias("status"), as_of.alias("created_at"))


def review_events(docs: DataFrame) -> DataFrame:
    """Review-complete events: documents with an assignee."""
    return docs.filter(F.coalesce("assigned_to", F.lit("")) != "").select(
        F.col("id").alias("document_id"), F.col("assigned_to").alias("user_id"))


def account_mail(events: DataFrame, users: DataFrame, option: str, brand: str, as_of: Column) -> DataFrame:
    """Account mails for events (user_id, email, what the text needs, and an
    event_id to keep if there is one).

    The opt-out belongs to the user named in the event, else to the user with
    that address; an address nobody owns gets the mail.
    """
    by_id = users.select(F.col("id").alias("__user"), F.col("email_preferences").alias("__p1"))
    by_mail = users.filter("email is not null").select(F.col("email").alias("__mail"), F.col("email_preferences").alias("__p2"))
    joined = events.join(by_id, F.col("user_id") == F.col("__user"), "left")
    joined = joined.join(by_mail, F.col("user_id").isNull() & (F.col("email") == F.col("__mail")), "left")
    joined = joined.filter(wants_mail(F.coalesce("__p1", "__p2"), option))

    def has(name: str) -> Column:
        return F.col(name) if name in events.columns else F.lit(None).cast("string")

    plan = F.coalesce(F.nullif(has("plan_tier"), F.lit("")), F.lit("pro"))
    values = {
        "brand": F.lit(brand), "name": display_name(has("full_name"), F.col("email")),
        "plan": F.concat(F.upper(F.substring(plan, 1, 1)), F.lower(F.substring(plan, 2, 2**31 - 1))),
        "amount": money(F.coalesce(has("amount_cents").cast("long"), F.lit(0))),
        "inviter": F.coalesce(F.nullif(has("inviter"), F.lit("")), F.lit("An administrator")), "link": has("link"),
    }
    subject, body = ACCOUNT_MAILS[option]
    tag = [c for c in events.columns if c == "event_id"]
    return joined.select(
        *tag, F.lit(ACCOUNT_DOCUMENT).alias("document_id"), F.col("email").alias("to_email"),
        fill(subject, values).alias("subject"), fill(body, values).alias("body"),
        F.lit("pending").alias("status"), as_of.alias("created_at"))


def delivery_update(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Outbox after delivery results (id, error, sent_at): pending rows become
    sent, or failed with the error."""
    r = results.select(F.col("id").alias("__id"), F.col("error").alias("__error"), F.col("sent_at").alias("__sent"))
    joined = outbox.join(r, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return joined.withColumns({
        "status": F.when(~hit, F.col("status")).when(F.col("__error").isNull(), "sent").otherwise("failed"),
        "error": F.when(hit, F.col("__error")).otherwise(F.col("error")),
        "sent_at": F.when(hit & F.col("__error").isNull(), F.col("__sent")).otherwise(F.col("sent_at")),
    }).select(*outbox.columns)
