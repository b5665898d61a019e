"""Snapshots of any size, changed bucket by bucket.

The rows of a snapshot lie in folders by a checksum of their key. A change reads and writes only the buckets that its keys
fall into, in a new version; a manifest, written last, says which version holds each bucket. A reader follows one manifest,
so it sees a version whole or not at all, and older versions stay readable.

    data/version=V/bucket=B/    rows that version V wrote
    manifest/version=V/         one row a bucket: its rows and the version that holds them
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clerkwise.streaming.ingest import read_or_empty

BUCKETS = 64
MANIFEST = "bucket int, held int, rows long, key string, buckets int, form string, version int"


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key by its text; a null key is the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % buckets).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/manifest", MANIFEST)


def _write(rows: DataFrame, path: str, key: str, buckets: int, version: int, kept: DataFrame | None) -> DataFrame:
    """Write ``rows`` as the buckets of a new version and its manifest, ``kept`` being the entries of all other buckets; returns the new entries."""
    spark, form = rows.sparkSession, rows.schema
    placed = rows.withColumn("bucket", bucket_of(F.col(f"`{key}`"), buckets))
    # An attempt that was broken off left no manifest, so its data may be replaced.
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    found = spark.read.schema(StructType([*form.fields]).add("bucket", "integer")).parquet(f"{path}/data/version={version}")
    own = found.groupBy("bucket").agg(F.lit(version).alias("held"), F.count(F.lit(1)).alias("rows")).select(
        "bucket", "held", "rows", F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(form.json()).alias("form"))
    whole = own if kept is None else own.unionByName(kept)
    # At most one row a bucket. Of two writers of one version the second fails here.
    whole.coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")
    return own


def write_snapshot(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """The first version of a snapshot, or a new one that replaces all of the latest."""
    last = _manifests(df.sparkSession, path).agg(F.max("version")).first()[0] or 0
    _write(df, path, key, buckets, last + 1, None)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of the latest version, or of a given one; ``only`` reads some buckets. No other folder is listed or opened."""
    manifests = _manifests(spark, path)
    if version is None:
        version = manifests.agg(F.max("version")).first()[0]
    entries = manifests.filter(F.col("version") == F.lit(version)).collect()   # one row a bucket
    if not entries:
        raise ValueError(f"no version {version} of a snapshot at {path}")
    form = StructType.fromJson(json.loads(entries[0]["form"]))
    paths = [f"{path}/data/version={e['held']}/bucket={e['bucket']}" for e in entries if e["rows"] and (only is None or e["bucket"] in only)]
    return spark.read.schema(form).parquet(*paths) if paths else spark.createDataFrame([], form)


def change_snapshot(spark: SparkSession, path: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A new version in which ``apply(rows, changes)`` replaces the rows of the buckets that ``changes`` fall into.

    ``changes`` has the snapshot's key column. Returns what was written: bucket, held (the new version) and rows. Buckets that no
    change falls into are neither read nor written. The update, upsert and delete operators of ``operators.changes`` serve as ``apply``.
    """
    manifests = _manifests(spark, path)
    version = manifests.agg(F.max("version")).first()[0]
    entries = manifests.filter(F.col("version") == F.lit(version))
    first = entries.first()
    key, buckets = first["key"], first["buckets"]
    touched = sorted(r["bucket"] for r in changes.select(bucket_of(F.col(f"`{key}`"), buckets).alias("bucket")).distinct().collect())
    after = apply(read_snapshot(spark, path, version, touched), changes)
    kept = entries.filter(~F.col("bucket").isin(touched)).drop("version") if touched else entries.drop("version")
    return _write(after, path, key, buckets, version + 1, kept).select("bucket", "held", "rows")


def bucketed_table(df: DataFrame, name: str, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``key``: two such tables of as many buckets join on it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
