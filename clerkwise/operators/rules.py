"""Routing rules: defaults, normalisation and the driver-side rule list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clerkwise.functions.literals import string_array, string_literal
from clerkwise.functions.text import strip
from clerkwise.schemas import RULES

DEFAULT_DEPARTMENT = "General Intake"

# Default rules in declaration order
# (doc_type, keywords, department, required fields).
DEFAULT_RULES = [
    ("building_permit",
     ["building permit", "construction", "parcel", "zoning", "site plan", "inspection"],
     "Building Department", ["applicant_name", "address", "parcel_number", "date"]),
    ("business_license",
     ["business license", "license renewal", "tax id", "llc", "business owner"],
     "Finance & Licensing", ["applicant_name", "address", "date"]),
    ("foi_request",
     ["freedom of information", "foia", "public records", "open records", "records request"],
     "City Clerk", ["applicant_name", "date"]),
    ("zoning_variance",
     ["zoning variance", "variance", "land use", "planning commission", "setback"],
     "Planning & Zoning", ["applicant_name", "address", "parcel_number", "date"]),
    ("complaint",
     ["complaint", "code violation", "noise", "nuisance", "unsafe", "report"],
     "Code Enforcement", ["applicant_name", "address", "date"]),
    ("benefits_application",
     ["benefits", "assistance", "eligibility", "application", "income", "household"],
     "Human Services", ["applicant_name", "address", "date"]),
    ("court_filing",
     ["court", "filing", "case", "petition", "respondent", "docket"],
     "Municipal Court", ["applicant_name", "case_number", "date"]),
    ("other", [], "General Intake", ["applicant_name", "date"]),
]

# A rule table is a settings file, read whole into the plan as literals.
RULE_TABLE_MAX_ROWS = 10_000
RULE_TABLE_MAX_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    doc_type: str
    keywords: tuple[str, ...]
    department: str
    required_fields: tuple[str, ...]
    sla_days: int | None = None


def default_rules(spark: SparkSession, sla: dict[str, int] | None = None) -> DataFrame:
    """Default rule rows; ``sla`` adds day limits, of which the defaults have none."""
    rows = [
        (doc_type, order, keywords, department, required, (sla or {}).get(doc_type))
        for order, (doc_type, keywords, department, required) in enumerate(DEFAULT_RULES)
    ]
    return spark.createDataFrame(rows, RULES)


def normalize_rules(raw: DataFrame, alphabetical: bool = False) -> DataFrame:
    """Clean user-written rules and add the fallback rule if it is missing.

    Input columns: doc_type, rule_order, keywords, department, required_fields
    and sla_days (any text or number). ``alphabetical`` gives saved rules their
    stored order: by key.
    """
    def cleaned(items: Column, lower: bool) -> Column:
        shaped = F.transform(items, lambda s: F.lower(strip(s)) if lower else strip(s))
        kept = F.array_distinct(F.filter(shaped, lambda s: s.isNotNull() & (s != "")))
        return F.coalesce(kept, F.array().cast("array<string>"))

    key = strip(F.col("doc_type"))
    department = strip(F.col("department"))
    rules = raw.select(
        key.alias("doc_type"),
        F.col("rule_order").cast("int").alias("rule_order"),
        cleaned(F.col("keywords"), True).alias("keywords"),
        F.when(F.coalesce(department, F.lit("")) == "", F.lit(DEFAULT_DEPARTMENT))
        .otherwise(department).alias("department"),
        cleaned(F.col("required_fields"), False).alias("required_fields"),
        F.expr("try_cast(trim(cast(sla_days as string)) as int)").alias("sla_days"),
    )
    fallback = default_rules(raw.sparkSession).filter("doc_type = 'other'").withColumn(
        "rule_order", F.lit(2**31 - 1))
    present = rules.filter("doc_type = 'other'").select("doc_type")
    rules = rules.unionByName(fallback.join(present, "doc_type", "left_anti"))
    if alphabetical:
        from clerkwise.session import number_rows

        columns = rules.columns
        numbered = number_rows(rules.drop("rule_order"), ["doc_type"], "rule_order")
        rules = numbered.withColumn("rule_order", (F.col("rule_order") - 1).cast("int")).select(*columns)
    return rules


def rule_errors(raw: DataFrame) -> DataFrame:
    """Rows that normalisation refuses, with the reason."""
    key = F.coalesce(strip(F.col("doc_type")), F.lit(""))
    sla = F.col("sla_days").cast("string")
    reason = (
        F.when(key == "", F.lit("document type keys cannot be empty"))
        .when(F.col("keywords").isNull(), F.concat(F.lit("rule '"), key, F.lit("'.keywords must be a list")))
        .when(F.col("required_fields").isNull(),
              F.concat(F.lit("rule '"), key, F.lit("'.required_fields must be a list")))
        .when((F.coalesce(sla, F.lit("")) != "") & F.expr("try_cast(trim(cast(sla_days as string)) as int) is null"),
              F.concat(F.lit("rule '"), key, F.lit("'.sla_days must be a whole number")))
    )
    return raw.select(F.col("doc_type"), reason.alias("reason")).filter("reason is not null")


def rule_key_order(rules: DataFrame) -> DataFrame:
    """Keys in display order: alphabetical, the fallback last."""
    return rules.orderBy(F.col("doc_type") == "other", "doc_type")


def fits_literals(rules: DataFrame) -> bool:
    """Whether the table is small enough to travel inside the plan; reads at most one row more than that."""
    some = rules.select("keywords").limit(RULE_TABLE_MAX_ROWS + 1)
    rows, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("keywords", ""))), F.lit(0))).first()
    return rows <= RULE_TABLE_MAX_ROWS and size <= RULE_TABLE_MAX_BYTES


def rule_list(rules: DataFrame) -> list[Rule]:
    """The rule table as literals for the plan, behind a size check. Larger tables are for ``classify``, ``route``,
    ``validate`` and ``process_documents``, which read them as tables."""
    rows = rules.limit(RULE_TABLE_MAX_ROWS + 1).collect()
    size = sum(len(k) for r in rows for k in r["keywords"])
    if len(rows) > RULE_TABLE_MAX_ROWS or size > RULE_TABLE_MAX_BYTES:
        raise ValueError("rule table is larger than a settings table may be")
    rows.sort(key=lambda r: (r["rule_order"], r["doc_type"]))
    return [
        Rule(r["doc_type"], tuple(r["keywords"]), r["department"],
             tuple(r["required_fields"]), r["sla_days"])
        for r in rows
    ]


def literal_rules(sla: dict[str, int] | None = None) -> list[Rule]:
    """The default rules without a round trip through a DataFrame."""
    return [
        Rule(doc_type, tuple(keywords), department, tuple(required), (sla or {}).get(doc_type))
        for doc_type, keywords, department, required in DEFAULT_RULES
    ]


def as_rules(rules: DataFrame | list[Rule]) -> list[Rule]:
    return rules if isinstance(rules, list) else rule_list(rules)


def lookup(rules: list[Rule], doc_type: str, attribute: str) -> Column:
    """Rule attribute by type with the fallback rule for unknown types.

    A ``case`` over literals: no join, no shuffle.
    """
    def value(rule: Rule) -> str:
        raw = getattr(rule, attribute)
        if attribute == "sla_days":
            return f"CAST({'NULL' if raw is None else raw} AS int)"
        return string_array(raw) if isinstance(raw, tuple) else string_literal(raw)

    fallback = next(rule for rule in rules if rule.doc_type == "other")
    cases = [f"WHEN {string_literal(r.doc_type)} THEN {value(r)}" for r in rules if r.doc_type != "other"]
    return F.expr(" ".join([f"CASE {doc_type}", *cases, f"ELSE {value(fallback)} END"]) if cases else value(fallback))
