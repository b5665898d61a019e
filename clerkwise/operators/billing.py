"""Plans, quotas, revenue and subscription state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clerkwise.functions.dates import month_start
from clerkwise.functions.text import _literal_map

# Monthly prices in cents, monthly document limits, paying events.
MONTHLY_PRICE = {"pro": 2900, "enterprise": 9900}
DOCUMENT_LIMIT = {"free": 50, "pro": 5000}
REVENUE_EVENTS = ("checkout.session.completed", "invoice.paid")

# Provider status to our status; anything else counts as active.
STATUS_MAP = {
    "active": "active",
    "past_due": "past_due",
    "canceled": "canceled",
    "unpaid": "past_due",
    "incomplete": "past_due",
    "incomplete_expired": "canceled",
}

ADMISSION_SALTS = 64


def billing_stats(subscriptions: DataFrame, payments: DataFrame, as_of: Column,
                  revenue_events: tuple[str, ...] = REVENUE_EVENTS) -> DataFrame:
    """Active subscriptions, monthly recurring revenue and 30-day revenue."""
    active = F.col("status") == "active"
    price = F.coalesce(F.try_element_at(_literal_map(MONTHLY_PRICE), F.lower(F.trim(F.col("plan_tier")))), F.lit(0))
    subs = subscriptions.agg(
        F.count_if(active).alias("active_subscriptions"),
        F.coalesce(F.sum(F.when(active & (F.col("billing_type") == "monthly"), price.cast("long"))), F.lit(0))
        .alias("mrr_cents"))
    since = as_of - F.make_dt_interval(F.lit(30))
    paid = payments.filter((F.col("created_at") >= since) & F.col("event_type").isin(*revenue_events)).agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("revenue_last_30_days_cents"))
    long = [t.unpivot([], t.columns, "metric", "value") for t in (subs, paid)]
    return long[0].unionByName(long[1])


def mrr_by_plan(subscriptions: DataFrame) -> DataFrame:
    price = F.coalesce(F.try_element_at(_literal_map(MONTHLY_PRICE), F.lower(F.trim(F.col("plan_tier")))), F.lit(0))
    return subscriptions.filter("status = 'active' and billing_type = 'monthly'").groupBy("plan_tier").agg(
        F.count(F.lit(1)).alias("total")).withColumn("mrr_cents", (F.col("total") * price).cast("long"))


def plan_distribution(users: DataFrame) -> DataFrame:
    return users.groupBy(F.coalesce(F.nullif("plan_tier", F.lit("")), F.lit("free")).alias("plan_tier")).agg(
        F.count(F.lit(1)).alias("total")).orderBy(F.col("total").desc(), "plan_tier")


def documents_this_month(docs: DataFrame, as_of: Column, key: str = "workspace_id") -> DataFrame:
    """Documents of the current month per workspace (or per any other key)."""
    return docs.filter(F.col("created_at") >= month_start(as_of)).groupBy(key).agg(F.count(F.lit(1)).alias("used"))


def document_limit(plan: Column) -> Column:
    return F.try_element_at(_literal_map(DOCUMENT_LIMIT), plan)


def quota_check(docs: DataFrame, workspaces: DataFrame, as_of: Column) -> DataFrame:
    """Used, limit and whether one more document, a connector or stored model
    replies are allowed, per workspace."""
    used = documents_this_month(docs, as_of).withColumnRenamed("workspace_id", "__ws")
    joined = workspaces.join(used, F.col("id") == F.col("__ws"), "left")
    plan = F.coalesce("plan_tier", F.lit("free"))
    count = F.coalesce("used", F.lit(0))
    cap = document_limit(plan)
    return joined.select(
        F.col("id").alias("workspace_id"), plan.alias("plan_tier"), count.alias("used"),
        cap.cast("long").alias("limit"), (cap.isNull() | (count < cap)).alias("allowed"),
        (plan != "free").alias("connectors_allowed"), (plan != "free").alias("replies_allowed"))


def admit_batch(batch: DataFrame, quota: DataFrame, order: list[str]) -> DataFrame:
    """Mark the first documents of a batch that still fit each quota.

    Only the row at the quota edge is needed, never a numbering of the whole
    workspace: salted groups each keep their first ``room`` rows, the survivors
    (at most salts times room per workspace) give the edge, and one comparison
    per row decides.
    """
    room = quota.select(F.col("workspace_id").alias("__ws"),
                        F.when(F.col("limit").isNotNull(),
                               F.greatest(F.col("limit") - F.col("used"), F.lit(0))).alias("__room"))
    rows = batch.join(room, F.col("workspace_id") == F.col("__ws"), "left").withColumn("__at", F.struct(*order))
    capped = rows.filter("__room > 0").select("workspace_id", "__room", "__at", F.pmod(F.xxhash64(*order), F.lit(ADMISSION_SALTS)).alias("__salt"))
    first = W.partitionBy("workspace_id", "__salt").orderBy("__at")
    kept = capped.withColumn("__n", F.row_number().over(first)).filter("__n <= __room")
    ranked = kept.withColumn("__n", F.row_number().over(W.partitionBy("workspace_id").orderBy("__at")))
    edge = ranked.filter("__n <= __room").groupBy(F.col("workspace_id").alias("__ews")).agg(F.max("__at").alias("__edge"))
    marked = rows.join(edge, F.col("workspace_id") == F.col("__ews"), "left")
    allowed = F.col("__room").isNull() | F.coalesce((F.col("__room") > 0) & (F.col("__at") <= F.col("__edge")), F.lit(False))
    return marked.select(*batch.columns, allowed.alias("allowed"))


EVENT_ORDER = ["created_at", "sequence", "event_id", "event_type", "provider_status", "plan_tier", "period_end"]


def subscription_fold(events: DataFrame) -> DataFrame:
    """State of each subscription after its event log.

    Events: event_id, sequence (arrival number), subscription_id, event_type,
    provider_status, plan_tier, period_end, created_at. A repeated event id is
    ignored; a null value keeps the older one. Events are taken by created_at, then sequence; of events alike in both
    the smaller event_id comes first, then the smaller event_type, provider_status, plan_tier and period_end (nulls first), so the
    result does not depend on the order of the rows. Only a checkout creates a subscription: events
    before its first one change nothing, and without one there is no row. An event belongs to one
    subscription, so one shuffle by subscription serves all steps.
    """
    placed = events.repartition("subscription_id")
    nth = F.row_number().over(W.partitionBy("subscription_id", "event_id").orderBy(*EVENT_ORDER))
    once = placed.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    begun = F.min(F.when(F.col("event_type") == "checkout.session.completed", F.struct(*EVENT_ORDER)))
    once = (once.withColumn("__begun", begun.over(W.partitionBy("subscription_id")))
            .filter(F.struct(*EVENT_ORDER) >= F.col("__begun")).drop("__begun"))
    kind = F.col("event_type")
    mapped = F.coalesce(F.try_element_at(_literal_map(STATUS_MAP), F.col("provider_status")), F.lit("active"))
    change = kind.isin("customer.subscription.updated", "customer.subscription.deleted")
    ended = (kind == "customer.subscription.deleted") | (change & (mapped == "canceled"))
    status = (
        F.when(kind.isin("checkout.session.completed", "invoice.paid"), "active")
        .when(kind == "invoice.payment_failed", "past_due")
        .when(ended, "canceled")
        .when(change, mapped)
    )
    plan = (
        F.when(kind == "checkout.session.completed", F.coalesce("plan_tier", F.lit("pro")))
        .when(ended, F.lit("free"))
    )
    at = F.struct(*EVENT_ORDER)
    effects = once.withColumns({
        "__status": status, "__plan": plan, "__at": at,
        "__end": F.when(kind == "invoice.paid", F.col("period_end")),
        "__canceled": F.when(ended, F.col("created_at")),
    }).filter("__status is not null")

    def last(col: str) -> Column:
        return F.max_by(col, F.when(F.col(col).isNotNull(), F.col("__at")))

    return effects.groupBy("subscription_id").agg(
        last("__status").alias("status"), last("__plan").alias("plan_tier"),
        last("__end").alias("current_period_end"), last("__canceled").alias("canceled_at"))
