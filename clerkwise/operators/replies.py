"""Stored classifier, enrichment and OCR replies as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.once import compute_once
from clerkwise.functions.predicates import empty
from clerkwise.functions.scores import clamp_confidence
from clerkwise.functions.text import strip
from clerkwise.operators.rules import Rule, as_rules, lookup

# Enrichment answers that mean "not there", and the contact aliases.
PLACEHOLDERS = ("", "n/a", "na", "none", "null", "unknown", "not provided", "missing")
EMAIL_ALIASES = ("email", "applicant_email", "contact_email", "sender_email")


def with_payload(df: DataFrame, reply: str, name: str) -> DataFrame:
    """Add the JSON object inside a model reply as text: the reply after its code
    fence is removed, or else its widest brace block. Null when neither is an
    object."""
    out = compute_once(df, {"__bare": strip(F.col(reply))})
    bare, inner = F.col("__bare"), F.btrim(F.col("__bare"), F.lit("`"))
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    out = compute_once(out, {"__whole": F.when(F.startswith(bare, F.lit("```")), inner).otherwise(bare)})
    out = compute_once(out, {"__whole": _object_or_null(F.col("__whole"))})
    block = F.when(F.col("__whole").isNull() & F.contains(F.col(reply), F.lit("{")),
                   F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    out = compute_once(out, {"__block": block})
    return out.withColumn(name, F.coalesce("__whole", _object_or_null(F.col("__block")))).drop("__bare", "__whole", "__block")


def _object_or_null(text: Column) -> Column:
    """The text when it is one JSON object and nothing else.

    The parser stops after the first value, so the text is tried inside a list
    and inside an object: only white space may follow to be valid in both.
    """
    listed = F.schema_of_variant(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    nested = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    alone = F.startswith(listed, F.lit("ARRAY<OBJECT")) & nested.isNotNull()
    return F.when(F.startswith(strip(text), F.lit("{")), F.when(alone, text))


def _number(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "double")


def _string(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "string")


def normalise_replies(df: DataFrame, rules: DataFrame | list[Rule], reply: str = "reply", keywords: int | None = None) -> DataFrame:
    """Add reply_* columns read from classifier replies; rows without a usable
    object keep null columns and so fall back to the rules. ``keywords`` bounds the list."""
    rules = as_rules(rules)
    known = [r.doc_type for r in rules]
    parsed = with_payload(df, reply, "__json")
    parsed = compute_once(parsed, {"__v": F.try_parse_json(F.col("__json"))})
    payload = F.col("__v")
    there = F.col("__json").isNotNull()
    kind = F.lower(strip(F.coalesce(_string(payload, "$.doc_type"), F.lit("other"))))
    parsed = compute_once(parsed, {
        "reply_doc_type": F.when(there, F.when(kind.isin(*known), kind).otherwise(F.lit("other")))})
    urgency = F.lower(strip(F.coalesce(_string(payload, "$.urgency"), F.lit("normal"))))
    own = F.nullif(_string(payload, "$.department"), F.lit(""))
    routed = lookup(rules, "reply_doc_type", "department")
    words = F.try_variant_get(payload, "$.matched_keywords", "array<string>")
    return parsed.withColumns({
        "reply_department": F.when(there, F.coalesce(own, routed)),
        "reply_urgency": F.when(there, F.when(urgency.isin("high", "normal"), urgency)
                                .otherwise(F.lit("normal"))),
        "reply_confidence": F.when(there, clamp_confidence(_number(payload, "$.confidence"))),
        "reply_keywords": F.when(there, F.coalesce(words if keywords is None else F.slice(words, 1, keywords),
                                                   F.array().cast("array<string>"))),
        "reply_rationale": F.when(there, _string(payload, "$.rationale")),
    }).drop("__json", "__v")


def normalise_enrichment(df: DataFrame, reply: str = "reply",
                         required: str = "required_fields", longest: int | None = None) -> DataFrame:
    """Add enriched_fields (map), enriched_confidence and enriched_notes. ``longest`` cuts values."""
    parsed = with_payload(df, reply, "__json")
    parsed = compute_once(parsed, {"__v": F.try_parse_json(F.col("__json"))})
    inner = F.try_variant_get(F.col("__v"), "$.fields", "map<string,string>")
    has_fields = F.try_variant_get(F.col("__v"), "$.fields", "variant").isNotNull()
    whole = F.from_json(F.col("__json"), "map<string,string>")
    raw = F.when(has_fields, inner).otherwise(whole)
    allowed = F.concat(F.coalesce(F.col(required), F.array().cast("array<string>")),
                       F.array(*[F.lit(a) for a in EMAIL_ALIASES]))
    trimmed = F.transform_values(raw, lambda _, v: strip(F.coalesce(v, F.lit("None"))))
    kept = F.map_filter(trimmed, lambda k, v: F.array_contains(allowed, k)
                        & ~F.lower(v).isin(*PLACEHOLDERS))
    short = F.transform_values(kept, lambda _, v: strip(v if longest is None else F.substring(v, 1, longest)))
    fields = F.map_filter(short, lambda _, v: v != "")
    nothing = F.from_json(F.lit("{}"), "map<string,string>")
    return parsed.withColumns({
        "enriched_fields": F.coalesce(fields, nothing),
        "enriched_confidence": clamp_confidence(_number(F.col("__v"), "$.confidence")),
        "enriched_notes": strip(_string(F.col("__v"), "$.notes")),
    }).drop("__json", "__v")


def fill_fields(fields: Column, extra: Column) -> Column:
    """Extra values fill absent or empty keys and never overwrite."""
    return F.map_zip_with(fields, extra, lambda _, own, new: F.when(empty(own), F.coalesce(new, own)).otherwise(own))


def filled_names(fields: Column, extra: Column) -> Column:
    """Sorted names that ``fill_fields`` takes from the extra values."""
    return F.array_sort(F.filter(F.map_keys(extra), lambda k: empty(F.try_element_at(fields, k))))


def flatten_ocr(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ocr_text, ocr_method and ocr_confidence from stored OCR results.

    Text is the content, else all lines of all pages; null when both are empty.
    """
    schema = """content string, pages array<struct<lines:array<struct<content:string>>>>,
                documents array<struct<confidence:double>>"""
    parsed = compute_once(df, {"__r": F.from_json(F.col(reply), schema)})
    result = F.col("__r")
    lines = F.flatten(F.transform(result["pages"], lambda p: F.coalesce(
        F.transform(p["lines"], lambda line: line["content"]), F.array().cast("array<string>"))))
    joined = F.array_join(F.filter(lines, lambda t: t.isNotNull() & (t != "")), "\n")
    text = F.coalesce(F.nullif(strip(result["content"]), F.lit("")), F.nullif(joined, F.lit("")))
    scores = F.transform(F.filter(result["documents"], lambda d: d.isNotNull()),
                         lambda d: F.coalesce(d["confidence"], F.lit(0.0)))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.92))
    return parsed.withColumns({
        "ocr_text": text,
        "ocr_method": F.when(text.isNotNull(), F.lit("stored_ocr")),
        "ocr_confidence": F.when(text.isNotNull(), clamp_confidence(mean)),
    }).drop("__r")
