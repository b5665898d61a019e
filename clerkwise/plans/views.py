"""Intake tables derived from the star-schema test tables.

Every view is a narrow expression over the given tables, so its size follows
theirs. Times are literals: results do not depend on the day of the run.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clerkwise.functions.dates import days, instant
from clerkwise.session import spread, use_utc
from clerkwise.sources.tables import read_table

AS_OF = "1998-07-01 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"

HEADS = (
    "Building permit and site plan for construction, inspection wanted",
    "Business license renewal by the business owner",
    "Request under the freedom of information act",
    "Zoning variance and setback",
    "Noise complaint and unsafe street report",
    "Application for income assistance",
    "Petition to the court",
    "A plain letter",
)
STATUSES = ("ingested", "needs_review", "routed", "acknowledged", "assigned", "in_progress",
            "completed", "approved", "corrected", "failed")
TYPES = ("building_permit", "business_license", "foi_request", "complaint", "court_filing")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Views:
    """The derived tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str, spread_scans: bool = False):
        self.spark, self.folder, self.spread_scans = use_utc(spark), folder, spread_scans
        self.as_of, self.events_as_of = instant(AS_OF), instant(EVENTS_AS_OF)

    def table(self, name: str) -> DataFrame:
        scan = read_table(self.spark, self.folder, name)
        return spread(scan) if self.spread_scans and name in ("orders", "documents", "lineitem") else scan

    @cached_property
    def wide(self) -> Views:
        """The same tables for work that is heavy per row."""
        return Views(self.spark, self.folder, spread_scans=True)

    @cached_property
    def intake_docs(self) -> DataFrame:
        """id, text, created_at, filename: one letter per order."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        key = F.col("o_orderkey")
        joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        lines = [
            pick(HEADS, key % 8),
            F.when(key % 5 != 0, F.concat(F.lit("Applicant: "), F.col("n_name"))),
            F.when(key % 7 != 0, F.concat(F.lit("Address: "), (key % 900).cast("string"), F.lit(" Main St"))),
            F.when(key % 3 != 0, F.concat(F.lit("Parcel Number: P-"), F.lpad((key % 100000).cast("string"), 5, "0"))),
            F.when(key % 16 == 6, F.concat(F.lit("Case Number: C-"), F.lpad((key % 100000).cast("string"), 5, "0"))),
            F.concat(F.lit("Date: "), F.date_format("o_orderdate", "MM/dd/yyyy")),
            F.concat(F.lit("Amount: $"), F.format_string("%.2f", F.col("o_totalprice"))),
            F.when(key % 4 == 0, F.concat(F.lit("Email: user"), F.col("o_custkey").cast("string"), F.lit("@example.com"))),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("This is urgent")),
        ]
        return joined.select(
            key.alias("id"), F.concat_ws("\n", *lines).alias("text"), F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("letter_"), key.cast("string"), F.lit(".txt")).alias("filename"))

    @cached_property
    def doc_ledger(self) -> DataFrame:
        """Document snapshot: one row per order."""
        o, c = self.table("orders"), self.table("customer")
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        sla = (F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 7)
               .when(F.col("o_orderpriority") == "3-MEDIUM", 14).when(F.col("o_orderpriority") == "5-LOW", 30))
        mail = F.concat(F.lit("user"), cust.cast("string"), F.lit("@example.com"))
        fields = F.map_filter(F.create_map(
            F.lit("applicant_name"), F.when(key % 5 != 0, F.col("c_name")),
            F.lit("applicant_email"), F.when(key % 6 == 0, mail).when(key % 6 == 1, F.lit("not an address")),
            F.lit("contact_email"), F.when(key % 6 == 1, mail).when(key % 6 == 2, F.lit("  ")),
            F.lit("email"), F.when(key % 4 == 0, mail)), lambda _, v: v.isNotNull())
        missing = F.filter(F.array(F.when(key % 5 == 0, F.lit("applicant_name")),
                                   F.when(key % 9 == 0, F.lit("date"))), lambda x: x.isNotNull())
        base = o.join(c, o.o_custkey == c.c_custkey).select(
            key.alias("id"), F.concat(F.lit("ws"), (cust % 3).cast("string")).alias("workspace_id"),
            F.concat(F.lit("File_"), key.cast("string"), pick((".txt", ".PDF", ".docx"), key % 3)).alias("filename"),
            F.concat(F.lit("store/"), key.cast("string")).alias("storage_path"),
            pick(("upload", "connector_s3", "watched_folder"), cust % 3).alias("source_channel"),
            F.lit("text/plain").alias("content_type"),
            pick(STATUSES, F.expr("(o_orderkey div 3) % 10")).alias("status"),
            F.when(key % 7 < 5, pick(TYPES, key % 7 % 5)).alias("doc_type"),
            F.when(key % 11 != 0, F.col("c_mktsegment")).alias("department"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("normal").alias("urgency"),
            ((key % 100) / F.lit(100.0)).alias("confidence"), (key % 4 == 0).alias("requires_review"),
            F.concat(F.lit("text of "), key.cast("string")).alias("extracted_text"),
            fields.alias("extracted_fields"), missing.alias("missing_fields"),
            F.transform(missing, lambda m: F.concat(F.lit("Missing required field: "), m)).alias("validation_errors"),
            F.lit(None).cast("string").alias("reviewer_notes"), F.col("o_orderdate").alias("created_at"),
            (F.col("o_orderdate") + days(cust % 10)).alias("updated_at"), sla.alias("sla_days"),
            F.when(key % 5 == 1, F.lit(" ")).when(key % 5 > 1, F.concat(F.lit("u"), (key % 7).cast("string"))).alias("assigned_to"))
        return base.withColumn("due_date", F.when(F.col("sla_days").isNotNull(), F.col("created_at") + days(F.col("sla_days"))))

    @cached_property
    def audit_events(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("document_id"),
            F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"),
            F.col("props").alias("details"), F.col("ts").alias("created_at"),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ws"), (F.col("user_id") % 3).cast("string"))).alias("workspace_id"))

    @cached_property
    def notifications(self) -> DataFrame:
        """Errors are overdue notices; other events are general ones."""
        e = self.table("events")
        user = F.col("user_id")
        return e.select(
            F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("document_id"),
            F.when(F.col("event_type") == "error", "overdue").otherwise(F.col("event_type")).alias("type"),
            F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("u"), (user % 7).cast("string"))).alias("user_id"),
            F.concat(F.lit("ws"), (user % 3).cast("string")).alias("workspace_id"),
            (F.col("event_id") % 3 == 0).alias("is_read"), F.col("ts").alias("created_at"),
            F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"))

    @cached_property
    def users(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        prefs = (F.when(key % 5 == 0, F.lit('{"doc_assigned": false, "custom": true}'))
                 .when(key % 5 == 1, F.lit('{"doc_review_complete": false, "account_welcome": false}'))
                 .when(key % 5 == 2, F.lit("not json")))
        return c.select(
            F.concat(F.lit("u"), key.cast("string")).alias("id"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.when(key % 3 != 0, F.col("c_name")).alias("full_name"),
            F.when(key % 50 == 7, "admin").otherwise("member").alias("role"), F.lit("active").alias("status"),
            pick(("free", "pro", "enterprise"), key % 3).alias("plan_tier"),
            F.when(key % 2 == 0, F.concat(F.lit("cus_"), key.cast("string"))).alias("stripe_customer_id"),
            prefs.alias("email_preferences"),
            (F.lit("1995-01-01").cast("timestamp") + days(key % 1000)).alias("created_at"))

    @cached_property
    def workspaces(self) -> DataFrame:
        """One workspace per supplier."""
        s = self.table("supplier")
        key = F.col("s_suppkey")
        return s.select(
            F.concat(F.lit("ws"), key.cast("string")).alias("id"),
            F.when(key % 3 == 0, F.lit("City Hall!")).when(key % 3 == 1, F.lit("  Town -- Works "))
            .otherwise(F.col("s_name")).alias("name"),
            F.concat(F.lit("u"), (key * 3).cast("string")).alias("owner_id"),
            pick(("free", "pro", "enterprise"), key % 3).alias("plan_tier"),
            F.when(key % 4 == 0, F.concat(F.lit("cus_"), (key * 2).cast("string"))).alias("stripe_customer_id"),
            (F.lit("1995-01-01").cast("timestamp") + days(key % 97)).alias("created_at"))

    @cached_property
    def members(self) -> DataFrame:
        """Two memberships per user, spread over the workspaces of the data."""
        c = self.table("customer")
        key = F.col("c_custkey")
        joined = F.lit("1995-06-01").cast("timestamp") + days(key % 30)
        first = c.select((key % 10).alias("w"), key, F.when(key % 4 == 0, "admin").otherwise("member").alias("role"), joined.alias("joined_at"))
        second = c.select((key % 7 + 1).alias("w"), key, F.when(key % 3 == 0, "admin").otherwise("member").alias("role"), joined.alias("joined_at"))
        second = second.filter(F.col("w") != key % 10)
        return first.unionByName(second).select(
            F.concat(F.lit("ws"), F.col("w").cast("string")).alias("workspace_id"),
            F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), "role", "joined_at")

    @cached_property
    def subscriptions(self) -> DataFrame:
        o = self.table("orders")
        key = F.col("o_orderkey")
        return o.select(
            key.alias("id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
            F.concat(F.lit("ws"), (F.col("o_custkey") % 10).cast("string")).alias("workspace_id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "enterprise").when(F.col("o_orderpriority") == "2-HIGH", "pro")
            .otherwise("free").alias("plan_tier"),
            F.when(key % 2 == 0, "monthly").otherwise("lifetime").alias("billing_type"),
            F.when(F.col("o_orderstatus") == "P", "active").when(F.col("o_orderstatus") == "F", "past_due")
            .otherwise("canceled").alias("status"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def payments(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("user_id"),
            F.when(F.col("l_returnflag") == "A", "checkout.session.completed").when(F.col("l_returnflag") == "R", "invoice.paid")
            .otherwise("invoice.payment_failed").alias("event_type"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_cents"),
            F.col("l_shipdate").alias("created_at"), "l_partkey", "l_extendedprice")

    @cached_property
    def jobs(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("id"), F.col("event_type").alias("job_type"),
            pick(("queued", "running", "in_progress", "failed", "completed"), F.col("event_id") % 5).alias("status"),
            (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
            F.col("props").alias("payload"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"),
            F.lit(None).cast("timestamp").alias("finished_at"))

    @cached_property
    def emails(self) -> DataFrame:
        o = self.table("orders")
        key = F.col("o_orderkey")
        return o.select(
            key.alias("id"), F.concat(F.lit("ws"), (F.col("o_custkey") % 3).cast("string")).alias("workspace_id"),
            pick(("sent", "pending", "failed"), key % 3).alias("status"), F.col("o_orderdate").alias("created_at"),
            F.when(key % 3 == 0, F.col("o_orderdate") + days(F.lit(1))).alias("sent_at"),
            F.lit(None).cast("string").alias("error"))

    @cached_property
    def templates(self) -> DataFrame:
        """Letter templates, one per part; three names carry the known hints."""
        p = self.table("part")
        key = F.col("p_partkey")
        name = (F.when(key % 40 == 3, F.concat(F.lit("Acknowledgment "), key.cast("string")))
                .when(key % 40 == 4, F.concat(F.lit("Request for Information "), key.cast("string")))
                .when(key % 40 == 5, F.concat(F.lit("Status Update "), key.cast("string")))
                .otherwise(F.concat(F.col("p_name"), F.lit(" "), key.cast("string"))))
        body = F.concat(
            F.lit("Dear {{applicant_name}},\n{{filename}} ({{doc_type}}) is {{status}} at {{department}}. {{unknown}} Ref {{id}} "),
            F.col("p_brand"))
        return p.select(key.alias("id"), F.when(key % 4 == 1, F.concat(F.lit("ws"), (key % 3).cast("string"))).alias("workspace_id"),
                        name.alias("name"), body.alias("template_body"))

    @cached_property
    def workflow_rules(self) -> DataFrame:
        """Rules of the workspaces (one per region and nation row) and global ones."""
        n = self.table("nation")
        key = F.col("n_nationkey")
        filters = pick((
            "{}", '{"doc_type": ["complaint", "foi_request"], "urgency": "high"}', '{"department": "BUILDING", "min_confidence": 0.5}',
            '{"max_confidence": "0.25", "doc_type": ""}', '{"min_confidence": "high"}', '{"doc_type": []}',
            '{"status": "needs_review", "source_channel": ["upload"], "other_key": 1}', "broken"), key % 8)
        actions = pick((
            '[{"type": "assign", "config": {"assignee": "workspace_owner"}}, {"type": "create_notification", "config": {"title": "See {{filename}}", "message": "{{status}} {{confidence}} {{due_date}}"}}]',
            '[{"type": "transition", "config": {"status": "acknowledged", "notes": " noted "}}]',
            '[{"type": "send_template_email", "config": {"template_name_hint": "status update"}}]',
            '[{"type": "assign", "config": {"user_id": "u5", "only_if_unassigned": false}}, {"type": "transition", "config": {"to_status": "approved"}}]',
            '[{"type": "webhook_post", "config": {"url": "https://hooks.example.com/in"}}, {"type": "unknown"}]'), key % 5)
        return n.select(
            key.cast("long").alias("id"), F.when(key % 3 != 0, F.concat(F.lit("ws"), (key % 3 - 1).cast("string"))).alias("workspace_id"),
            F.concat(F.lit("rule "), F.col("n_name")).alias("name"), (key % 13 != 5).alias("enabled"),
            F.when(key % 6 == 5, "document_ingested").otherwise("document_processed").alias("trigger_event"),
            filters.alias("filters_json"), actions.alias("actions_json"))

    @cached_property
    def requests(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", "user_id", F.col("event_type").alias("path"),
                        F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
                        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
                        (F.col("value") / 10).alias("latency"), "ts")

    @cached_property
    def listing(self) -> DataFrame:
        """Connector listing: documents by source, with repeated ids."""
        d = self.table("documents")
        key = F.col("doc_id")
        name = F.when(key % 13 == 0, F.lit(" ")).otherwise(F.concat(
            F.lit("doc_"), key.cast("string"), pick((".txt", ".json", ".exe", ".MD", ".csv"), key % 5)))
        return d.select(
            self._connector(), F.concat(F.lit("x"), F.expr("doc_id div 2").cast("string")).alias("external_id"),
            key.alias("position"), name.alias("filename"),
            F.when(key % 17 == 0, "video/mp4").otherwise("text/plain").alias("content_type"),
            F.when(key % 19 == 0, F.lit(0)).otherwise(F.col("n_chars") * 20000).alias("length"))

    @staticmethod
    def _connector() -> Column:
        return F.concat(F.lit("src"), F.expr("doc_id div 2 % 3").cast("string")).alias("connector_type")

    @cached_property
    def sync_ledger(self) -> DataFrame:
        """Ids taken in before: those of the labelled documents."""
        return self.table("labels").filter("quality = 0").select(
            self._connector(), F.concat(F.lit("x"), F.expr("doc_id div 2").cast("string")).alias("external_id"))

    @cached_property
    def replies(self) -> DataFrame:
        """Stored classifier replies of some letters."""
        o = self.table("orders")
        key = F.col("o_orderkey")
        score = ((key % 100) / F.lit(100.0)).cast("string")
        reply = (
            F.when(key % 6 == 0, F.concat(
                F.lit('```json\n{"doc_type": " Complaint ", "confidence": '), score,
                F.lit(', "urgency": "HIGH", "matched_keywords": ["a", "b"], "rationale": "r"}\n```')))
            .when(key % 6 == 1, F.concat(
                F.lit('Sure: {"doc_type": "mystery", "confidence": "0.5", "department": "Desk '),
                F.col("o_orderpriority"), F.lit('"} done')))
            .when(key % 6 == 3, F.lit('{"doc_type": "court_filing", "confidence": 1.7, "department": "", "urgency": "low", "matched_keywords": "x"}'))
            .when(key % 6 == 4, F.lit("no json here"))
            .otherwise(F.lit("[1, 2]")))
        return o.filter(key % 6 != 2).select(key.alias("id"), reply.alias("reply"))

    @cached_property
    def enrichments(self) -> DataFrame:
        """Stored enrichment replies of the letters."""
        o = self.table("orders")
        key = F.col("o_orderkey")
        text = key.cast("string")
        reply = (
            F.when(key % 4 == 0, F.concat(
                F.lit('{"fields": {"applicant_name": "  Jane '), text,
                F.lit(' ", "date": "N/A", "extra": "x", "email": "j@x.org"}, "confidence": 0.7, "notes": " n "}')))
            .when(key % 4 == 1, F.concat(
                F.lit('{"applicant_name": "Unknown", "address": "'), F.repeat(F.lit("12 Long Road "), 30),
                F.lit('", "parcel_number": "P'), text, F.lit('"}')))
            .when(key % 4 == 2, F.lit("bad"))
            .otherwise(F.lit('{"fields": [1]}')))
        return o.select(key.alias("id"), reply.alias("reply"))

    @cached_property
    def ocr_replies(self) -> DataFrame:
        p = self.table("part")
        key = F.col("p_partkey")
        reply = (
            F.when(key % 4 == 0, F.concat(F.lit('{"content": "  '), F.col("p_name"), F.lit(' ", "documents": [{"confidence": 0.5}, {"confidence": 0.75}]}')))
            .when(key % 4 == 1, F.concat(
                F.lit('{"content": " ", "pages": [{"lines": [{"content": "'), F.col("p_name"), F.lit('"}, {"content": ""}]}, {"lines": [{"content": "'),
                F.col("p_brand"), F.lit('"}]}, {}]}')))
            .when(key % 4 == 2, F.lit('{"pages": []}'))
            .otherwise(F.concat(F.lit('{"content": "'), F.col("p_type"), F.lit('", "documents": [{"confidence": 1.5}, {}]}'))))
        return p.select(key.alias("id"), reply.alias("reply"))

    @cached_property
    def subscription_events(self) -> DataFrame:
        """Provider events per order; line numbers above 5 repeat an event id."""
        li = self.table("lineitem")
        number = F.col("l_linenumber")
        kind = pick(("customer.subscription.updated", "checkout.session.completed", "invoice.paid", "invoice.payment_failed",
                     "customer.subscription.deleted", "charge.other"), (F.col("l_partkey") + number) % 6)
        return li.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), (number % 5).cast("string")).alias("event_id"),
            number.cast("long").alias("sequence"), F.col("l_orderkey").alias("subscription_id"), kind.alias("event_type"),
            pick(("active", "past_due", "canceled", "unpaid", "odd"), F.col("l_suppkey") % 5).alias("provider_status"),
            F.when(F.col("l_suppkey") % 2 == 0, "enterprise").alias("plan_tier"),
            F.when(F.col("l_quantity") > 10, F.col("l_shipdate") + days(F.lit(30))).alias("period_end"),
            F.col("l_shipdate").alias("created_at"), "l_partkey", "l_quantity", "l_suppkey").drop("l_partkey", "l_quantity", "l_suppkey")
