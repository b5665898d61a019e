"""Set-oriented changes of a table snapshot.

Plain Parquet has no in-place update, so each operator returns the new snapshot;
the caller writes it to a new path and swaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key. The rank limit is applied before the shuffle too,
    so a hot key sends one row per map task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def update_by_key(base: DataFrame, changes: DataFrame, key: str, columns: list[str],
                  as_of: Column | None = None, stamp: str = "updated_at") -> DataFrame:
    """Overwrite ``columns`` of the rows named in ``changes``; unknown keys do
    nothing. ``changes`` holds one row per key."""
    renamed = changes.select(F.col(key).alias("__key"),
                             *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = base.join(renamed, base[key] == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    out = {c: F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    if as_of is not None:
        out[stamp] = F.when(hit, as_of).otherwise(F.col(stamp))
    return joined.withColumns(out).select(*base.columns)


def update_present(base: DataFrame, changes: DataFrame, key: str, columns: list[str],
                   as_of: Column | None = None, stamp: str = "updated_at") -> DataFrame:
    """As ``update_by_key``, but a null in ``changes`` keeps the old value."""
    renamed = changes.select(F.col(key).alias("__key"),
                             *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = base.join(renamed, base[key] == F.col("__key"), "left")
    out = {c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in columns}
    if as_of is not None:
        out[stamp] = F.when(F.col("__key").isNotNull(), as_of).otherwise(F.col(stamp))
    return joined.withColumns(out).select(*base.columns)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Append the new rows whose key is free; the first of equal new keys wins."""
    return base.unionByName(new_rows(base, new, keys, order), allowMissingColumns=True)


def null_safe_anti(rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key is not in ``taken``; a null in a key equals a null."""
    other = taken.select(*[F.col(k).alias(f"__taken_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[f"__taken_{k}"]) for k in keys])
    return rows.join(other, same, "left_anti")


def new_rows(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(null_safe_anti(new, base.select(*keys).distinct(), keys), keys, order)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: list[str],
           keep: list[str] | None = None) -> DataFrame:
    """Insert new keys and overwrite old ones with the last new row of the key.

    Columns in ``keep`` hold their old value when the key was there before.
    """
    last = last_per_key(new, keys, order)
    if keep:
        old = base.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__old"))
        same = reduce(lambda a, b: a & b, [last[k].eqNullSafe(old[f"__key_{k}"]) for k in keys])
        last = last.join(old, same, "left").withColumns({
            c: F.when(F.col("__old"), F.col(f"__old_{c}")).otherwise(F.col(c)) for c in keep
        }).select(*last.columns)
    rest = null_safe_anti(base, last.select(*keys), keys)
    return rest.unionByName(last, allowMissingColumns=True).select(*base.columns)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return null_safe_anti(base, gone.select(*keys).distinct(), keys)


def purge_before(df: DataFrame, ts_col: str, cutoff: Column) -> DataFrame:
    """Rows that retention keeps. With the log partitioned by the date of
    ``ts_col`` the filter drops whole partitions at planning time."""
    return df.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= cutoff))


def purge_count(df: DataFrame, ts_col: str, cutoff: Column) -> DataFrame:
    return df.agg(
        F.count_if(F.col(ts_col) < cutoff).alias("removed"),
        F.count_if(F.col(ts_col).isNull() | (F.col(ts_col) >= cutoff)).alias("kept"),
    )


# Retention in days.
RETENTION_DAYS = {"audit_events": 2555, "outbound_emails": 2555, "notifications": 730}


def retention_cutoff(table: str, as_of: Column) -> Column:
    return as_of - F.make_dt_interval(F.lit(RETENTION_DAYS[table]))


def backfill(df: DataFrame, col: str, value: Column) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), value))


# Tables whose rows without a workspace move to the default one.
BACKFILLED = ("documents", "notifications", "audit_events", "subscriptions", "invitations",
              "outbound_emails", "connector_configs", "jobs", "templates", "payment_events")


def backfill_workspace(tables: dict[str, DataFrame], workspaces: DataFrame, workspace_id: str) -> dict[str, DataFrame]:
    """The tables with their unowned rows in the default workspace; unchanged when any workspace exists."""
    if not workspaces.isEmpty():
        return tables
    return {name: backfill(df, "workspace_id", F.lit(workspace_id)) if name in BACKFILLED else df for name, df in tables.items()}


def bootstrap_workspace(users: DataFrame, workspaces: DataFrame, workspace_id: str,
                        as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Default workspace and its members, both empty when a workspace exists.

    The owner is the oldest admin, else the oldest user.
    """
    admin = F.lower(F.trim(F.col("role"))) == "admin"
    order = F.struct((~F.coalesce(admin, F.lit(False))).cast("int"), "created_at", "id")
    owner = users.agg(F.min_by("id", order)).first()[0]
    needed = F.lit(owner is not None and workspaces.isEmpty())
    default, who = F.lit(workspace_id), F.lit(owner)
    workspace = users.filter(needed & (F.col("id") == who)).select(
        default.alias("id"), F.lit("Default").alias("name"), F.lit("default").alias("slug"), who.alias("owner_id"),
        F.lit("free").alias("plan_tier"), F.lit("{}").alias("settings"), as_of.alias("created_at"), as_of.alias("updated_at"))
    members = users.filter(needed).select(
        default.alias("workspace_id"), F.col("id").alias("user_id"),
        F.when(F.col("id") == who, "admin").otherwise("member").alias("role"), as_of.alias("joined_at"))
    return workspace, members


def additive_union(tables: list[DataFrame]) -> DataFrame:
    """Rows of several schema versions under the union of their columns."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
