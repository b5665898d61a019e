"""Documents from text to routed or needs_review."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions import scores
from clerkwise.functions.dates import due_date
from clerkwise.functions.once import compute_once
from clerkwise.functions.text import field_columns, fields_map
from clerkwise.operators.classify import classify, missing_fields, validation_errors
from clerkwise.operators.listing import sweep_candidates
from clerkwise.operators.replies import fill_fields, filled_names, normalise_enrichment, normalise_replies
from clerkwise.operators.rule_search import classify_by_table, with_attributes
from clerkwise.operators.rules import Rule, as_rules, fits_literals, lookup

# Columns that processing writes back to a document.
CHECKED_FIELDS = ("parcel_number", "date")  # judged by their format whatever the rules require
RESULT_COLUMNS = ("status", "doc_type", "department", "urgency", "confidence", "requires_review",
                  "extracted_fields", "missing_fields", "validation_errors", "sla_days", "due_date")


def extract_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """One column per field, null when absent."""
    out, fields = field_columns(compute_once(df, {"__lowered": F.lower(text)}), F.col(text), F.col("__lowered"))
    return out.select(*df.columns, *[col.alias(name) for name, col in fields.items()])


def extract_field_map(df: DataFrame, text: str = "text", lowered: str = "__lowered",
                      names: Iterable[str] | None = None) -> DataFrame:
    """The present fields as the map extracted_fields."""
    out, fields = field_columns(df, F.coalesce(text, F.lit("")), F.col(lowered), names)
    return out.select(*df.columns, fields_map(fields).alias("extracted_fields"))


def process_documents(df: DataFrame, rules: DataFrame | list[Rule], as_of: Column,
                      replies: DataFrame | None = None, enrichments: DataFrame | None = None,
                      threshold: float = scores.REVIEW_THRESHOLD, forced: Iterable[str] = (), wanted: Iterable[str] | None = None,
                      longest: int | None = None) -> DataFrame:
    """Add the result columns to rows of (id, text, extraction_confidence, created_at).

    ``wanted`` names the result columns that will be read; patterns and keyword lists that none of
    them needs are not evaluated, and the map extracted_fields then holds only fields that are judged.

    Without stored replies this is one narrow projection: no join, no shuffle. A rule table that is too large for the plan
    is searched as a table and joined for its attributes; stored replies need one that fits.
    ``replies`` and ``enrichments`` (id, reply) are joined on the id; ``longest`` cuts the values that
    enrichments bring to so many characters (None: as they are). Rows whose
    ``extraction_error`` column, if there is one, is set become ``failed``.
    """
    table = rules if isinstance(rules, DataFrame) and replies is None and not fits_literals(rules) else None
    rules = [] if table is not None else as_rules(rules)
    out = df
    if "extraction_confidence" not in df.columns:
        out = out.withColumn("extraction_confidence", F.lit(0.99))
    text, low = F.coalesce(F.col("text"), F.lit("")), F.col("__lowered")
    out = compute_once(out, {"__lowered": F.lower(text)})
    names, listed = None, True
    if wanted is not None and replies is None and enrichments is None:
        wanted = set(wanted)
        listed = "matched_keywords" in wanted
        if "extracted_fields" not in wanted and table is None:
            names = {f for rule in rules for f in rule.required_fields} | set(CHECKED_FIELDS)
    out = extract_field_map(out, names=names)
    if replies is not None:
        # The rules judge only texts that no usable reply decides: for the others there is nothing to search.
        out = with_replies(out, replies, rules)
        out = compute_once(out, {"__lowered": F.when(F.col("__rid").isNull(), low).otherwise(F.lit(""))})
    out = compute_once(out, {"urgency": scores.urgency(low)})
    if table is not None:
        out = with_attributes(classify_by_table(out, table, lowered="__lowered", keywords=listed), table, ["department", "required_fields", "sla_days"])
        out = out.withColumn("department", F.col("__rule_department"))
        required, sla = F.col("__rule_required_fields"), F.col("__rule_sla_days")
    else:
        out = classify(out, rules, lowered="__lowered", keywords=listed)
        out = out.withColumn("department", lookup(rules, "doc_type", "department"))
        required, sla = lookup(rules, "doc_type", "required_fields"), lookup(rules, "doc_type", "sla_days")
    out = out.drop("__lowered")
    if replies is not None:
        out = prefer_replies(out)
    out = compute_once(out, {"missing_fields": missing_fields(F.col("extracted_fields"), required)})
    if enrichments is not None:
        out = merge_enrichment(out, enrichments, required, longest)
    out = compute_once(out, {"validation_errors": validation_errors(F.col("extracted_fields"), F.col("missing_fields"))})
    errors = F.size("validation_errors")
    score = scores.penalised_confidence(F.col("classification_confidence"), F.col("extraction_confidence"), errors)
    out = out.withColumn("__score", score)
    flag = scores.needs_review(F.col("__score"), errors, F.col("doc_type"), threshold, forced)
    created = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
    out = out.withColumns({"confidence": F.round("__score", 4), "requires_review": flag, "sla_days": sla})
    out = out.withColumns({
        "status": F.when(F.col("requires_review"), "needs_review").otherwise("routed"),
        "due_date": due_date(created, F.col("sla_days"), as_of),
    }).drop("__score", "__rule_department", "__rule_required_fields", "__rule_sla_days")
    return isolate_failures(out) if "extraction_error" in df.columns else out


def isolate_failures(df: DataFrame) -> DataFrame:
    """A failed row keeps its place but not its results."""
    bad = F.col("extraction_error").isNotNull()
    cleared = {c: F.when(~bad, F.col(c)) for c in RESULT_COLUMNS if c not in ("status", "requires_review")}
    return df.withColumns(cleared | {
        "status": F.when(bad, "failed").otherwise(F.col("status")),
        "requires_review": bad | F.col("requires_review"),
    })


def with_replies(df: DataFrame, replies: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with the usable stored reply of each document; ``__rid`` is null where there is none."""
    typed = normalise_replies(replies.select(F.col("id").alias("__rid"), "reply"), rules)
    typed = typed.filter("reply_doc_type is not null").drop("reply", "reply_rationale")
    return df.join(typed, F.col("id") == F.col("__rid"), "left")


def prefer_replies(joined: DataFrame) -> DataFrame:
    """A usable stored reply (see ``with_replies``) decides type, department, urgency and confidence;
    the rules decide for all other documents."""
    has = F.col("__rid").isNotNull()
    pairs = {"doc_type": "reply_doc_type", "department": "reply_department", "urgency": "reply_urgency",
             "classification_confidence": "reply_confidence", "matched_keywords": "reply_keywords"}
    return joined.withColumns({own: F.when(has, F.col(new)).otherwise(F.col(own)) for own, new in pairs.items()} | {
        "classified_by": F.when(has, "reply").otherwise("rules")}).drop("__rid", *pairs.values())


def merge_enrichment(df: DataFrame, enrichments: DataFrame, required: Column, longest: int | None = None) -> DataFrame:
    """Fill absent or blank fields of documents with missing fields; adds
    filled_fields and sets missing_fields anew. ``longest`` cuts the values."""
    side = enrichments.select(F.col("id").alias("__eid"), F.col("reply").alias("__reply"))
    joined = df.withColumn("__required", required).join(side, F.col("id") == F.col("__eid"), "left")
    typed = normalise_enrichment(joined, "__reply", "__required", longest)
    nothing = F.from_json(F.lit("{}"), "map<string,string>")
    extra = F.when(F.size("missing_fields") > 0, F.col("enriched_fields")).otherwise(nothing)
    typed = typed.withColumn("__extra", extra)
    # Two steps: inside a lambda a name would mean the new column of the same list.
    typed = typed.withColumn("filled_fields", filled_names(F.col("extracted_fields"), F.col("__extra")))
    typed = typed.withColumn("extracted_fields", fill_fields(F.col("extracted_fields"), F.col("__extra")))
    return typed.withColumn(
        "missing_fields", missing_fields(F.col("extracted_fields"), F.col("__required"))
    ).drop("__required", "__eid", "__reply", "__extra", "enriched_fields", "enriched_confidence", "enriched_notes")


def processing_audit(processed: DataFrame, actor: str, as_of: Column,
                     threshold: float = scores.REVIEW_THRESHOLD) -> DataFrame:
    """One audit row per document: processed with its figures, or failed."""
    failed = F.col("status") == "failed"
    flag = F.initcap(F.col("requires_review").cast("string"))
    done = F.concat(F.lit("doc_type="), F.coalesce("doc_type", F.lit("")), F.lit(" confidence="),
                    F.coalesce(F.col("confidence").cast("string"), F.lit("")),
                    F.lit(" requires_review="), flag, F.lit(f" threshold={threshold}"))
    error = F.col("extraction_error") if "extraction_error" in processed.columns else F.lit(None).cast("string")
    return processed.select(
        F.col("id").alias("document_id"), F.when(failed, "pipeline_failed").otherwise("pipeline_processed").alias("action"),
        F.lit(actor).alias("actor"), F.when(failed, error).otherwise(done).alias("details"), as_of.alias("created_at"))


def review_notifications(processed: DataFrame, as_of: Column) -> DataFrame:
    """A notice for every document that needs a person."""
    return processed.filter("requires_review and status <> 'failed'").select(
        F.lit("needs_review").alias("type"),
        F.concat(F.lit("Review needed: "), F.coalesce("filename", F.lit("Unknown"))).alias("title"),
        F.concat(F.lit("Type: "), F.col("doc_type"), F.lit(", Confidence: "), F.col("confidence").cast("string")).alias("message"),
        F.col("id").alias("document_id"), F.lit(False).alias("is_read"), as_of.alias("created_at"))


def reprocess(snapshot: DataFrame, texts: DataFrame, chosen: DataFrame, rules: DataFrame | list[Rule],
              as_of: Column, **options) -> DataFrame:
    """New snapshot after the chosen documents (id) ran again with today's
    rules. ``texts`` (id, text, extraction_confidence) is read for them only."""
    from clerkwise.operators.changes import update_by_key

    ids = chosen.select(F.col("id").alias("__want")).distinct()
    again = texts.join(ids, F.col("id") == F.col("__want"), "left_semi")
    dates = snapshot.select(F.col("id").alias("__sid"), "created_at")
    again = again.join(dates, F.col("id") == F.col("__sid"), "inner").drop("__sid")
    processed = process_documents(again, rules, as_of, **options)
    columns = [c for c in RESULT_COLUMNS if c in snapshot.columns]
    return update_by_key(snapshot, processed.select("id", *columns), "id", columns, as_of)


def reupload(snapshot: DataFrame, uploads: DataFrame, rules: DataFrame | list[Rule], as_of: Column,
             **options) -> DataFrame:
    """Replace file name and type of documents (id, filename, content_type,
    text) and run them again; id and history stay."""
    from clerkwise.operators.changes import update_by_key

    renamed = update_by_key(snapshot, uploads, "id", ["filename", "content_type"], as_of)
    return reprocess(renamed, uploads.drop("filename", "content_type"), uploads, rules, as_of, **options)


def reply_sweep(docs: DataFrame, texts: DataFrame, replies: DataFrame, rules: DataFrame | list[Rule],
                as_of: Column, limit: int, include_failed: bool = False) -> DataFrame:
    """Run the first manual documents again, stored replies first; counts."""
    chosen = sweep_candidates(docs, limit, include_failed).select(F.col("id").alias("__want"), "created_at")
    again = texts.join(chosen, F.col("id") == F.col("__want"), "inner").drop("__want")
    done = process_documents(again, rules, as_of, replies=replies)
    return done.agg(F.count(F.lit(1)).alias("processed_count"),
                    F.count_if(F.col("status") == "routed").alias("auto_cleared_count"),
                    F.count_if(F.col("status") != "routed").alias("still_manual_count"))
