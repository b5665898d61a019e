"""JSON text columns and option maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mail options, all on unless the user turns one off.
MAIL_OPTIONS = ("account_welcome", "account_plan_change", "account_payment_receipt",
                "account_invitation", "doc_assigned", "doc_review_complete", "doc_digest")


def json_object(col: Column) -> Column:
    """JSON object text to a map; blank or malformed text gives an empty map."""
    parsed = F.from_json(col, "map<string,string>")
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))


def json_list(col: Column) -> Column:
    """JSON array text to an array; blank or malformed text gives an empty array."""
    parsed = F.from_json(col, "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def overlay(base: Column, top: Column) -> Column:
    """Union of two maps; a key of ``top`` wins over the same key of ``base``."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def mail_options(stored: Column) -> Column:
    """Stored options over the defaults."""
    defaults = F.create_map(*[p for key in MAIL_OPTIONS for p in (F.lit(key), F.lit("true"))])
    return overlay(defaults, json_object(stored))


def updated_mail_options(stored: Column, change: Column) -> Column:
    """Merge a change into the options; unknown keys of the change are ignored."""
    known = F.map_filter(json_object(change), lambda k, _: k.isin(*MAIL_OPTIONS))
    return overlay(mail_options(stored), known)


def wants_mail(stored: Column, option: str) -> Column:
    return truthy(mail_options(stored), option, True)


def truthy(options: Column, key: str, default: bool) -> Column:
    """Python-style truth of an option read from JSON text."""
    value = F.element_at(options, F.lit(key))
    off = value.isNull() | value.isin("", "false", "0", "0.0", "[]", "{}")
    return (
        F.when(F.map_contains_key(options, F.lit(key)), ~off)
        .otherwise(F.lit(default))
    )
