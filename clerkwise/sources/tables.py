"""Test and production tables, and table copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Copy order of the tables.
COPY_ORDER = ("documents", "audit_events", "deployments", "invitations", "api_keys", "users", "jobs",
              "notifications", "watched_files", "templates", "outbound_emails", "connector_configs",
              "connector_sync_log")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table with its zone-less times as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def copy_tables(sources: dict[str, DataFrame], target: str, truncate: bool = True) -> DataFrame:
    """Write each table under ``target`` in copy order; returns source and
    target row counts per table."""
    names = [n for n in COPY_ORDER if n in sources] + sorted(set(sources) - set(COPY_ORDER))
    spark = next(iter(sources.values())).sparkSession
    counts = None
    for name in names:
        sources[name].write.mode("overwrite" if truncate else "append").parquet(f"{target}/{name}")
        written = spark.read.schema(sources[name].schema).parquet(f"{target}/{name}")
        row = reconcile(name, sources[name], written)
        counts = row if counts is None else counts.unionByName(row)
    return counts


def reconcile(name: str, source: DataFrame, target: DataFrame) -> DataFrame:
    both = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        target.select(F.lit(0).alias("s"), F.lit(1).alias("t")))
    return both.agg(F.lit(name).alias("table"), F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
                    F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows"))
