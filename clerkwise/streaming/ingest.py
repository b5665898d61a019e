"""Incremental runs of the batch operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clerkwise.functions.text import basename, mime_guess
from clerkwise.operators.changes import purge_before, retention_cutoff
from clerkwise.operators.imports import connector_audit, new_documents, new_only, sync_log_rows, validate_files
from clerkwise.operators.rules import Rule
from clerkwise.operators.sla import overdue_notifications, sla_scan
from clerkwise.plans.process import process_documents
from clerkwise.session import broadcast_if_small
from clerkwise.sources.files import BINARY_SCHEMA, extract_text, fingerprint


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_PER_CORE = 16


def few_listing_tasks(spark: SparkSession) -> None:
    """From now on the session lists folders by a few tasks a core; Spark's own 10,000 cost far more than the listing of small
    folders. A file source lists in the session that made it, each time that it looks for files, so the setting stays."""
    most = LISTING_PER_CORE * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING)) > most:
        spark.conf.set(LISTING, str(most))


OPENING = "spark.sql.files.openCostInBytes"
OPENING_DEFAULT, OPENING_BYTES = "4194304b", 64 * 1024


def many_files_a_task(spark: SparkSession) -> None:
    """From now on the session deals up to some thousand small files to a task, and to all cores; Spark's own cost of 4 MB a file gives a task
    32. A file source deals them in the session that made it, so the setting stays; a value that was set is left alone."""
    if spark.conf.get(OPENING) == OPENING_DEFAULT:
        spark.conf.set(OPENING, str(OPENING_BYTES))


def folder_stream(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """New files of a folder, and of those below it if wanted, with their fingerprint (names starting with ``.``
    or ``_`` are left out by the source)."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", str(recursive).lower())
    few_listing_tasks(spark)
    many_files_a_task(spark)
    return _described(files.load(folder))


def read_or_empty(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    """A table that may not have been written yet. ``base`` is the folder below which folder names are columns."""
    reader = spark.read.schema(schema)
    try:
        found = (reader.option("basePath", base) if base else reader).parquet(path)
        found.schema  # noqa: B018  where plans are made elsewhere, a missing path shows only now
        return found
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


LEDGER = "file_hash string, filename string, source_path string, document_id string, created_at timestamp"
# A ledger lies in folders by a checksum of its key, so a batch reads only those that its own keys fall into.
LEDGER_BUCKETS = 256


def ledger_bucket(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key, F.lit("")).cast("binary")), F.lit(LEDGER_BUCKETS)).cast("int")


def _described(files: DataFrame) -> DataFrame:
    return files.withColumns({
        "filename": basename(F.col("path")),
        "file_hash": fingerprint(F.col("path"), F.col("length"), F.col("modificationTime")),
    }).withColumn("content_type", F.coalesce(mime_guess(F.col("filename")), F.lit("application/octet-stream")))


def _others(rows: DataFrame, key: str, ledger: str, columns: str, run: str, batch: int) -> DataFrame:
    """What other batches have taken in, of the buckets that ``rows`` fall into; a batch that runs again does not see itself."""
    touched = sorted(r["bucket"] for r in rows.select(ledger_bucket(F.col(key)).alias("bucket")).distinct().collect())
    schema = columns + ", bucket int, run string, batch long"
    if not touched:
        return rows.sparkSession.createDataFrame([], schema)
    known = read_or_empty(rows.sparkSession, f"{ledger}/bucket={{{','.join(map(str, touched))}}}", schema, ledger)
    return known.filter((F.col("run") != run) | (F.col("batch") != batch))


def _append_ledger(rows: DataFrame, key: str, ledger: str, run: str, batch: int) -> None:
    """Ledger rows of a batch. Its partitions are its own, and the same batch run again replaces them."""
    placed = rows.withColumns({"bucket": ledger_bucket(F.col(key)), "run": F.lit(run), "batch": F.lit(batch).cast("long")})
    # With a number, as the files cost more than their few rows: AQE would have one task write them all.
    tasks = min(LEDGER_BUCKETS, rows.sparkSession.sparkContext.defaultParallelism)
    (placed.repartition(tasks, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "run", "batch").parquet(ledger))


def _fresh(files: DataFrame, ledger: str, run: str, batch: int) -> DataFrame:
    """Acceptable files whose fingerprint no other batch has taken in. The content stays out of
    the shuffle that finds them: only the key columns are compared."""
    good = validate_files(files).filter("reject_reason is null").drop("reject_reason")
    known = _others(good, "file_hash", ledger, LEDGER, run, batch)
    if "content" not in files.columns:
        return new_only(good, known, ["file_hash"], ["path"])
    # A fingerprint holds the path, and a batch has each path once. A small ledger is lent to the tasks, else contents are shuffled to meet it.
    return good.join(broadcast_if_small(known.select("file_hash").distinct()), "file_hash", "left_anti")


def _store(fresh: DataFrame, ledger: str, documents: str, run: str, batch: int, as_of: Column) -> None:
    """Write the documents of a batch and then their ledger rows. Each batch of each run has
    its own folders, replaced whole, so a batch that runs again adds nothing and no other run's is touched."""
    place = f"run={run}/batch={batch}"
    rows = new_documents(fresh, ["file_hash"], "watched_folder", as_of)
    rows.write.mode("overwrite").parquet(f"{documents}/{place}")
    # The ledger is written from the stored documents, so both agree.
    stored = fresh.sparkSession.read.schema(rows.schema).parquet(f"{documents}/{place}")
    _append_ledger(stored.select("file_hash", "filename", F.col("path").alias("source_path"), F.col("id").alias("document_id"), "created_at"),
                   "file_hash", ledger, run, batch)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to; a new checkpoint has a new one."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def ingest_stream(spark: SparkSession, folder: str, ledger: str, documents: str, checkpoint: str,
                  as_of: Column, trigger: dict | None = None, recursive: bool = False) -> StreamingQuery:
    """Take in the new files of a folder. Rejected files stay out of the ledger.

    The file source offers every path once; ``ingest_folder`` also takes in
    files that changed.
    """
    return ingest_files(folder_stream(spark, folder, recursive), ledger, documents, checkpoint, as_of, trigger)


def ingest_files(files: DataFrame, ledger: str, documents: str, checkpoint: str, as_of: Column, trigger: dict | None = None) -> StreamingQuery:
    """Take in a stream of files (path, modificationTime, length, content), each version of a file once.

    A batch reads the ledger only in the buckets that its files fall into, and may run again without
    adding anything.
    """
    spark = files.sparkSession
    described = files if "file_hash" in files.columns else _described(files)

    def take(batch: DataFrame, number: int) -> None:
        run = _run_of(spark, checkpoint)
        _store(_fresh(batch, ledger, run, number), ledger, documents, run, number, as_of)

    return (described.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def ingest_folder(spark: SparkSession, folder: str, ledger: str, documents: str, batch: int, as_of: Column,
                  run: str = "scan") -> None:
    """One scheduled scan: take in new and changed files of a folder.

    The first pass reads names, sizes and times only. The second reads content,
    and the oldest fresh time is pushed to the scan so that older files are not
    opened. ``batch`` numbers the scans of a ``run``; use the same number to run one again.
    """
    files = spark.read.format("binaryFile").load(folder)
    fresh = _fresh(_described(files.drop("content")), ledger, run, batch)
    oldest = fresh.agg(F.min("modificationTime")).first()[0]
    if oldest is None:
        return
    wanted = fresh.select(F.col("path").alias("__path"), F.col("modificationTime").alias("__time"))
    content = files.filter(F.col("modificationTime") >= F.lit(oldest)).join(
        wanted, (F.col("path") == F.col("__path")) & (F.col("modificationTime") == F.col("__time")), "left_semi")
    _store(_described(content), ledger, documents, run, batch, as_of)


SYNC_LOG = """connector_type string, external_id string, filename string, document_id string,
              metadata_json string, created_at timestamp"""


SYNCED = "connector_type string, workspace_id string, last_sync_at timestamp"
SYNC_TARGETS = ("documents", "audit", "log", "synced")


def sync_batch(batch: DataFrame, store: str, run: str, number: int, as_of: Column, workspace_id: str | None = None, actor: str = "system") -> None:
    """Take in one batch of connector documents: the documents, an audit row for each, the log that keeps them from coming again, and when
    each connector was read. Refused ones stay out of the log, so a later listing may bring them again.

    All four targets lie under ``store``, the rows of a batch in partitions of their own. The log is written last but one: what it
    names has been stored. A batch that runs again, also after it was broken off halfway, replaces its own partitions and adds nothing.
    """
    from clerkwise.sources.connectors import acceptable

    spark = batch.sparkSession
    place = f"run={run}/batch={number}"
    good = acceptable(batch).filter("reject_reason is null").drop("reject_reason")
    known = _others(good, "external_id", f"{store}/log", SYNC_LOG, run, number)
    fresh = new_only(good, known, ["connector_type", "external_id"], ["position"])
    rows = new_documents(fresh, ["connector_type", "external_id"], "connector", as_of, workspace_id)
    rows = rows.withColumn("source_channel", F.concat(F.lit("connector_"), F.col("connector_type")))
    rows.write.mode("overwrite").parquet(f"{store}/documents/{place}")
    # The other targets are made from the stored documents, so all agree.
    stored = spark.read.schema(rows.schema).parquet(f"{store}/documents/{place}")
    connector_audit(stored, workspace_id, actor, as_of).write.mode("overwrite").parquet(f"{store}/audit/{place}")
    _append_ledger(sync_log_rows(stored, as_of), "external_id", f"{store}/log", run, number)
    read = batch.select("connector_type", F.lit(workspace_id).cast("string").alias("workspace_id"), as_of.alias("last_sync_at")).distinct()
    read.coalesce(1).write.mode("overwrite").parquet(f"{store}/synced/{place}")


def sync_stream(listing: DataFrame, store: str, checkpoint: str, as_of: Column, trigger: dict | None = None,
                workspace_id: str | None = None, actor: str = "system") -> StreamingQuery:
    """``sync_batch`` for a stream of external documents with a ``position``."""
    spark = listing.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        sync_batch(batch, store, _run_of(spark, checkpoint), number, as_of, workspace_id, actor)

    return (listing.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def synced_configs(configs: DataFrame, store: str) -> DataFrame:
    """Connector settings with the time of their last sync; those never read stay as they are."""
    last = (read_or_empty(configs.sparkSession, f"{store}/synced", SYNCED).groupBy("connector_type", "workspace_id")
            .agg(F.max("last_sync_at").alias("at")))
    kind = F.col("connector_type")
    # A sync without a workspace is one of all. One row for each connector, or connector and workspace.
    every = last.filter("workspace_id is null").select(kind.alias("__kind"), F.col("at").alias("__every"))
    own = last.select(kind.alias("__own_kind"), F.col("workspace_id").alias("__ws"), F.col("at").alias("__own"))
    joined = configs.join(every, kind == F.col("__kind"), "left").join(
        own, (kind == F.col("__own_kind")) & (F.col("workspace_id") == F.col("__ws")), "left")
    latest = F.greatest("__every", "__own")
    return joined.withColumns({c: F.coalesce(latest, F.col(c)) for c in ("last_sync_at", "updated_at")}).select(*configs.columns)


def process_stream(files: DataFrame, rules: list[Rule], as_of: Column, tasks: int | None = None) -> DataFrame:
    """Processing of a stream of files (id, filename, content_type, content):
    the batch projection, which keeps no state.

    One input file is one task. Where micro-batches have few but large files, ``tasks`` deals the rows of each out before
    the work that is heavy per row.
    """
    return process_documents(extract_text(files.repartition(tasks) if tasks else files), rules, as_of)


def sla_run(docs: DataFrame, notifications: DataFrame, as_of: Column) -> DataFrame:
    """One run of the scheduled overdue scan: the notices to append."""
    return overdue_notifications(sla_scan(docs, notifications, as_of), as_of)


def retention_run(tables: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """One run of the daily retention job: the rows to keep per table."""
    return {name: purge_before(df, "created_at", retention_cutoff(name, as_of)) for name, df in tables.items()}
