"""Session settings and the few helpers that look at cluster state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is measured to be below both limits.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

LOCAL_FOLDER = "/tmp/checkpoints"


def build_session(app: str = "clerkwise", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE starts
    from the cluster's own partition count and coalesces.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC instants throughout, so the session zone must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``; ``LOCAL_FOLDER`` is set
    only for a session inside one process that names none, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that outlive a step: the one that ``spark.checkpoint.dir`` names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Add a broadcast hint when ``df`` is measured to be small, else ask for a
    shuffle join (sorted, with AQE skew handling).

    Left to itself Spark would judge a large side by the bytes of its files, which say
    nothing of rows that are made on the way, and collect it on the driver. The probe
    stops after ``max_rows + 1`` rows.
    """
    width = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)))
        .first()
    )
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(df)
    return df.hint("merge")


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows; reads no more than that."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan with very few splits to all cores.

    For work that is heavy per row. A scan whose splits already occupy a quarter
    of the cores, as any large table does, stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or scan.rdd.getNumPartitions() * 4 > cores:
        return scan
    return scan.repartition(cores)


def number_rows(df: DataFrame, order: list[str], name: str,
                keys: list[str] | None = None) -> DataFrame:
    """Exact 1-based row numbers per ``keys`` (or over all rows) in ``order``.

    A plain window would put one key's rows into one task. Here the rows are
    range-partitioned on (keys, order), so a hot key spreads over many
    partitions; each partition numbers its own rows and adds the count of the
    same key in earlier partitions. ``order`` must be a total order.
    """
    from pyspark.sql import Window as W

    keys = keys or []
    slot, local, before = f"__{name}_slot", f"__{name}_local", f"__{name}_before"
    # Checkpointed: the slot of a row must not change if a task is run again.
    placed = checkpointed(
        df.repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn(slot, F.spark_partition_id())
    )
    numbered = placed.withColumn(
        local, F.row_number().over(W.partitionBy(slot, *keys).orderBy(*order))
    )
    # One row per (slot, key): at most one row per partition for any single key.
    counts = placed.groupBy(slot, *keys).agg(F.count(F.lit(1)).alias(before))
    earlier = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = counts.withColumn(
        before,
        F.coalesce(
            F.sum(before).over(earlier.orderBy(slot).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    joined = numbered.join(_null_safe_prefix(offsets, [slot] + keys),
                           _null_safe_on(numbered, [slot] + keys), "inner")
    return joined.select(*df.columns, (F.col(local) + F.col(before)).alias(name))


def _null_safe_prefix(df: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        df = df.withColumnRenamed(key, f"__off_{key}")
    return df


def _null_safe_on(left: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(F.col(f"__off_{key}"))
    return cond
