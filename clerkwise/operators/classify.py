"""Rule classification, validation and routing as narrow projections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.literals import string_array, string_literal
from clerkwise.functions.once import compute_once
from clerkwise.functions.predicates import empty
from clerkwise.functions.scores import classification_confidence
from clerkwise.operators.rule_search import classify_by_table, with_attributes
from clerkwise.operators.rules import Rule, as_rules, fits_literals, lookup

# Up to this many keywords the test is unrolled into generated code; beyond it
# the rules travel as array literals and are walked by higher-order functions.
UNROLLED_KEYWORDS = 400
KEYWORDS_PER_LITERAL = 20_000

_BEST = "struct<hits:int,back:int,doc_type:string,n:int,matched:array<string>>"


def classify(df: DataFrame, rules: DataFrame | list[Rule], text: str = "text",
             lowered: str | None = None, keywords: bool = True) -> DataFrame:
    """Add doc_type, classification_confidence and, unless told not to, matched_keywords.

    A keyword counts when it is a substring of the lower-cased text (column
    ``lowered`` if there is one already). Most hits win; on a tie the rule that
    comes first. No hit means ``other``. A rule table that is too large for the plan is searched as a
    table (``classify_by_table``).
    """
    if isinstance(rules, DataFrame) and not fits_literals(rules):
        return classify_by_table(df, rules, text, lowered, keywords)
    rules = [r for r in as_rules(rules) if r.keywords]
    base = df.withColumn("__low", F.col(lowered) if lowered else F.lower(F.coalesce(F.col(text), F.lit(""))))
    if not rules:
        best = F.lit(None).cast(_BEST)
        return _with_result(base.withColumn("__best", best))
    if sum(len(r.keywords) for r in rules) <= UNROLLED_KEYWORDS:
        # Hits per rule first, so that the winner alone lists its keywords.
        base = compute_once(base, {f"__h{i}": F.expr(_hits_sql(rule)) for i, rule in enumerate(rules)})
        ranked = ", ".join(f"named_struct('hits', __h{i}, 'back', -{i})" for i in range(len(rules)))
        top = f"greatest({ranked})" if len(rules) > 1 else ranked
        base = base.withColumn("__top", F.expr(top))
        best, none = "CASE WHEN __top.hits > 0 THEN CASE -__top.back", "END END"

        def of_best(values: list[str]) -> str:
            return " ".join([best, *[f"WHEN {i} THEN {value}" for i, value in enumerate(values)], none])

        words = F.expr(of_best([string_array(r.keywords) for r in rules]))
        made = {
            "doc_type": F.coalesce(F.expr(of_best([string_literal(r.doc_type) for r in rules])), F.lit("other")),
            "classification_confidence": classification_confidence(
                F.col("__top.hits"), F.expr(f"coalesce({of_best([str(len(r.keywords)) for r in rules])}, 1)")),
        }
        if keywords:
            made["matched_keywords"] = F.coalesce(F.filter(words, lambda k: F.contains(F.col("__low"), k)), F.array().cast("array<string>"))
        out = compute_once(base, made)
        return out.drop("__low", "__top", *[f"__h{i}" for i in range(len(rules))])
    slices = [_best_of(part) for part in _slices(rules)]
    best = F.greatest(*slices) if len(slices) > 1 else slices[0]
    return _with_result(compute_once(base, {"__best": best}))


def _hits_sql(rule: Rule) -> str:
    return " + ".join(f"int(contains(__low, {string_literal(k)}))" for k in rule.keywords)


def _slices(rules: list[Rule]) -> list[list[tuple[int, Rule]]]:
    parts: list[list[tuple[int, Rule]]] = [[]]
    size = 0
    for order, rule in enumerate(rules):
        if parts[-1] and size + len(rule.keywords) > KEYWORDS_PER_LITERAL:
            parts.append([])
            size = 0
        parts[-1].append((order, rule))
        size += len(rule.keywords)
    return parts


def _best_of(part: list[tuple[int, Rule]]) -> Column:
    """Best rule of one literal slice as a struct that compares by (hits, order)."""
    payload = json.dumps([{"o": o, "d": r.doc_type, "k": list(r.keywords)} for o, r in part])
    literal = F.from_json(F.lit(payload), "array<struct<o:int,d:string,k:array<string>>>")

    def scored(rule: Column) -> Column:
        matched = F.filter(rule["k"], lambda k: F.contains(F.col("__low"), k))
        return F.struct(F.size(matched).alias("hits"), (-rule["o"]).alias("back"),
                        rule["d"].alias("doc_type"), F.size(rule["k"]).alias("n"),
                        matched.alias("matched"))

    best = F.array_max(F.transform(literal, scored))
    return F.when(best["hits"] > 0, best)


def _with_result(df: DataFrame) -> DataFrame:
    best = F.col("__best")
    return compute_once(df, {
        "doc_type": F.coalesce(best["doc_type"], F.lit("other")),
        "classification_confidence": classification_confidence(
            F.coalesce(best["hits"], F.lit(0)), F.coalesce(best["n"], F.lit(1))),
        "matched_keywords": F.coalesce(best["matched"], F.array().cast("array<string>")),
    }).drop("__low", "__best")


def route(df: DataFrame, rules: DataFrame | list[Rule], doc_type: str = "doc_type") -> DataFrame:
    """Add department from the rule of the type, the fallback rule if unknown."""
    if isinstance(rules, DataFrame) and not fits_literals(rules):
        return with_attributes(df, rules, ["department"], doc_type).withColumnRenamed("__rule_department", "department")
    return df.withColumn("department", lookup(as_rules(rules), doc_type, "department"))


def validate(df: DataFrame, rules: DataFrame | list[Rule], doc_type: str = "doc_type",
             fields: str = "extracted_fields") -> DataFrame:
    """Add missing_fields and validation_errors."""
    table = isinstance(rules, DataFrame) and not fits_literals(rules)
    if table:
        df = with_attributes(df, rules, ["required_fields"], doc_type)
    required = F.col("__rule_required_fields") if table else lookup(as_rules(rules), doc_type, "required_fields")
    out = compute_once(df, {"missing_fields": missing_fields(F.col(fields), required)})
    out = compute_once(out, {"validation_errors": validation_errors(F.col(fields), F.col("missing_fields"))})
    return out.drop("__rule_required_fields")


def missing_fields(fields: Column, required: Column) -> Column:
    return F.filter(required, lambda f: empty(F.try_element_at(fields, f)))


def validation_errors(fields: Column, missing: Column) -> Column:
    """One message per missing field in rule order, then the two format checks."""
    parcel = F.try_element_at(fields, F.lit("parcel_number"))
    date = F.try_element_at(fields, F.lit("date"))
    checks = F.array(
        F.when(~empty(parcel) & ~parcel.rlike("^[A-Za-z0-9-]{4,30}$"),
               F.lit("Parcel number format looks invalid")),
        F.when(~empty(date) & (F.length(date) < 6), F.lit("Date format looks invalid")),
    )
    messages = F.transform(missing, lambda f: F.concat(F.lit("Missing required field: "), f))
    return F.concat(messages, F.array_compact(checks))
