"""Lookups between tables: first, latest and default rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payments_with_email(payments: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """Newest payments with the payer's address; cut before the join."""
    newest = payments.orderBy(F.col("id").desc()).limit(limit)
    people = users.select(F.col("id").alias("__user"), F.col("email").alias("user_email"))
    return newest.join(people, F.col("user_id") == F.col("__user"), "left").drop("__user")


def user_workspaces(workspaces: DataFrame, members: DataFrame) -> DataFrame:
    m = members.select(F.col("workspace_id").alias("__ws"), "user_id", F.col("role").alias("member_role"))
    return workspaces.join(m, F.col("id") == F.col("__ws"), "inner").drop("__ws")


def workspace_members(members: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("__user"), "email", "full_name", "status")
    return members.join(u, F.col("user_id") == F.col("__user"), "inner").drop("__user")


def default_workspace(members: DataFrame, workspaces: DataFrame) -> DataFrame:
    """One workspace per user: where they are admin first, then the oldest.

    ``min_by`` combines on the map side, so no user's rows are gathered.
    """
    w = workspaces.select(F.col("id").alias("__ws"), F.col("created_at").alias("__made"))
    joined = members.join(w, F.col("workspace_id") == F.col("__ws"), "inner")
    order = F.struct((F.col("role") != "admin").cast("int"), F.col("__made"), F.col("workspace_id"))
    return joined.groupBy("user_id").agg(
        F.min_by(F.struct("workspace_id", "role"), order).alias("__pick")
    ).select("user_id", F.col("__pick.workspace_id").alias("workspace_id"),
             F.col("__pick.role").alias("member_role"))


def latest_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key as one aggregate over a struct."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def active_subscription(subscriptions: DataFrame, keys: list[str]) -> DataFrame:
    """Newest running subscription (active or past due) of each key."""
    running = subscriptions.filter(F.col("status").isin("active", "past_due"))
    order = F.struct(F.col("created_at"), F.col("id"))
    return running.groupBy(*keys).agg(
        F.max_by(F.struct("id", "plan_tier", "status", "created_at"), order).alias("__row")
    ).select(*keys, "__row.*")


def effective_plan(users: DataFrame, members: DataFrame, workspaces: DataFrame,
                   subscriptions: DataFrame) -> DataFrame:
    """Plan per user: own running subscription, else the plan of the default
    workspace, else the user's plan, else free."""
    default = default_workspace(members, workspaces).select(F.col("user_id").alias("__u"), "workspace_id")
    plans = workspaces.select(F.col("id").alias("__ws"), F.col("plan_tier").alias("__ws_plan"))
    subs = active_subscription(subscriptions, ["user_id"]).select(
        F.col("user_id").alias("__su"), F.col("plan_tier").alias("__sub_plan"), F.col("status").alias("__sub_status"))
    out = users.join(default, F.col("id") == F.col("__u"), "left")
    out = out.join(plans, F.col("workspace_id") == F.col("__ws"), "left")
    out = out.join(subs, F.col("id") == F.col("__su"), "left")
    return out.select(
        F.col("id").alias("user_id"), "workspace_id",
        F.coalesce("__sub_plan", "__ws_plan", "plan_tier", F.lit("free")).alias("plan_tier"),
        F.coalesce("__sub_status", F.lit("active")).alias("status"))


def resolve_configs(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """Connector settings per request (workspace_id, connector_type): the row of
    the workspace, else the global row."""
    own = configs.filter("workspace_id is not null").select(
        F.col("workspace_id").alias("__w"), F.col("connector_type").alias("__t"),
        F.struct("config_json", "enabled", "last_sync_at").alias("__own"))
    shared = configs.filter("workspace_id is null").select(
        F.col("connector_type").alias("__g"),
        F.struct("config_json", "enabled", "last_sync_at").alias("__shared"))
    out = requests.join(own, (F.col("workspace_id") == F.col("__w")) & (F.col("connector_type") == F.col("__t")), "left")
    out = out.join(shared, F.col("connector_type") == F.col("__g"), "left")
    picked = F.coalesce(F.col("__own"), F.col("__shared"))
    return out.select(*requests.columns, F.coalesce(picked["config_json"], F.lit("{}")).alias("config_json"),
                      F.coalesce(picked["enabled"], F.lit(True)).alias("enabled"),
                      picked["last_sync_at"].alias("last_sync_at"))


def resolve_payment_accounts(events: DataFrame, workspaces: DataFrame, users: DataFrame,
                             default_of_user: DataFrame) -> DataFrame:
    """Workspace and user of a payment by customer id; without a workspace the
    default one of the user."""
    w = workspaces.filter("stripe_customer_id is not null").select(
        F.col("stripe_customer_id").alias("__wc"), F.col("id").alias("__w"))
    u = users.filter("stripe_customer_id is not null").select(
        F.col("stripe_customer_id").alias("__uc"), F.col("id").alias("__u"))
    d = default_of_user.select(F.col("user_id").alias("__du"), F.col("workspace_id").alias("__d"))
    out = events.join(w, F.col("customer_id") == F.col("__wc"), "left")
    out = out.join(u, F.col("customer_id") == F.col("__uc"), "left")
    out = out.join(d, F.col("__u") == F.col("__du"), "left")
    return out.select(*events.columns, F.col("__u").alias("user_id"),
                      F.coalesce("__w", "__d").alias("workspace_id"))


def lookup_ids(requested: DataFrame, docs: DataFrame, key: str = "document_id") -> DataFrame:
    """Requested ids with their document; unknown ids carry an error."""
    side = docs.withColumnRenamed("id", "__id")
    out = requested.join(side, F.col(key) == F.col("__id"), "left")
    return out.withColumn("error", F.when(F.col("__id").isNull(), F.lit("not found"))).drop("__id")


def audit_rows(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Audit rows ready to append: the workspace comes from the document when
    the event names none."""
    side = docs.select(F.col("id").alias("__id"), F.col("workspace_id").alias("__ws"))
    out = events.join(side, F.col("document_id") == F.col("__id"), "left")
    return out.withColumn("workspace_id", F.coalesce("workspace_id", "__ws")).drop("__id", "__ws")


def notification_rows(events: DataFrame, docs: DataFrame) -> DataFrame:
    return audit_rows(events, docs).withColumn("is_read", F.lit(False))


def unique_slugs(workspaces: DataFrame, order: list[str], base: Column) -> DataFrame:
    """Slug per workspace: the base, then base-2, base-3 ... in creation order.

    A base belongs to the first workspace whose name spells it; a number whose slug is
    another workspace's base (``x-2``) is passed over. A numbered slug ends in its number, so no other
    two can be equal.
    """
    from clerkwise.session import number_rows

    based = workspaces.withColumn("slug_base", base)
    numbered = number_rows(based, order, "__n", ["slug_base"])
    spelled = based.select("slug_base").distinct().select(
        F.regexp_extract("slug_base", "^(.+)-([1-9][0-9]*)$", 1).alias("__base"),
        F.regexp_extract("slug_base", "^(.+)-([1-9][0-9]*)$", 2).try_cast("long").alias("__taken")).filter("__taken >= 2")
    taken = spelled.groupBy("__base").agg(F.array_sort(F.collect_set("__taken")).alias("__taken"))
    marked = numbered.join(taken, F.col("slug_base") == F.col("__base"), "left")
    number = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__n").cast("bigint"),
                         lambda n, t: F.when((n > 1) & (t <= n), n + 1).otherwise(n))
    slug = F.when(F.col("__n") == 1, F.col("slug_base")).otherwise(F.concat("slug_base", F.lit("-"), number.cast("string")))
    return marked.withColumn("slug", slug).drop("__n", "__base", "__taken")
