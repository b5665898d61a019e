"""Placeholder rendering and recipient lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clerkwise.functions.dates import iso_utc
from clerkwise.functions.text import EMAIL_SHAPE, strip

# Placeholder keys in substitution order.
LETTER_KEYS = ("id", "filename", "doc_type", "department", "status", "urgency")
EVENT_KEYS = ("id", "workspace_id", "filename", "doc_type", "department", "status", "urgency",
              "confidence", "assigned_to", "due_date", "source_channel")

# Fields that may hold an address, in order of preference.
CONTACT_FIELDS = ("applicant_email", "contact_email", "sender_email", "email")


def letter_context() -> dict[str, Column]:
    """Base values of a letter; a missing value prints as None."""
    return {key: F.coalesce(F.col(key).cast("string"), F.lit("None")) for key in LETTER_KEYS}


def event_context() -> dict[str, Column]:
    """Base values of workflow text; a missing or zero value prints as nothing."""
    context = {key: F.coalesce(F.col(key).cast("string"), F.lit("")) for key in EVENT_KEYS}
    context["confidence"] = F.coalesce(decimal_text(F.col("confidence")), F.lit(""))
    context["due_date"] = F.coalesce(iso_utc(F.col("due_date")), F.lit(""))
    return context


def decimal_text(value: Column) -> Column:
    """Plain decimal text of a score; Java would print values under 0.001 as 1.0E-4."""
    fixed = F.regexp_replace(value.cast("decimal(20,17)").cast("string"), "0+$", "")
    plain = F.when((F.abs(value) < 0.001) & (F.abs(value) >= 0.0001), fixed)
    return F.when(value != 0, F.coalesce(plain, value.cast("string")))


def render(body: Column, context: dict[str, Column], fields: Column) -> Column:
    """Replace ``{{key}}`` for every key in order.

    Document fields override base values and follow them; a substituted value
    may itself hold a placeholder of a later key; unknown placeholders stay.
    """
    out = body
    for key, base in context.items():
        own = F.when(F.map_contains_key(fields, F.lit(key)),
                     F.coalesce(F.element_at(fields, F.lit(key)), F.lit("")))
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(own, base))
    extra = F.filter(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,string>"))),
                     lambda e: ~e["key"].isin(*context))
    return F.aggregate(
        extra, out,
        lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")),
                                  F.coalesce(e["value"], F.lit(""))),
    )


def recipient(fields: Column) -> Column:
    """First contact field that looks like an address."""
    options = []
    for key in CONTACT_FIELDS:
        value = strip(F.try_element_at(fields, F.lit(key)))
        options.append(F.when(value.rlike(EMAIL_SHAPE), value))
    return F.coalesce(*options)


def has_contact(fields: Column) -> Column:
    """Any contact field with something in it (looser than ``recipient``)."""
    found = F.lit(False)
    for key in CONTACT_FIELDS:
        value = strip(F.try_element_at(fields, F.lit(key)))
        found = found | (F.coalesce(value, F.lit("")) != "")
    return found
