"""Exports and append writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clerkwise.functions.dates import iso_utc
from clerkwise.functions.predicates import APPROVED
from clerkwise.functions.text import basename

# Columns of the CSV export.
METADATA = "document_id string, status string, trigger string, source_path string, export_path string, exported_at string, run string"
CSV_COLUMNS = ("id", "filename", "status", "doc_type", "department", "assigned_to", "due_date")


def approved_export(docs: DataFrame, export_dir: str, trigger: str, as_of: Column) -> DataFrame:
    """Metadata of approved documents that have stored content, one row per id."""
    status = F.lower(F.trim(F.col("status")))
    ready = docs.filter(status.isin(*APPROVED) & (F.coalesce(F.trim("storage_path"), F.lit("")) != ""))
    name = basename(F.coalesce(F.nullif("filename", F.lit("")), basename(F.col("storage_path"))))
    return ready.select(
        F.col("id").alias("document_id"), status.alias("status"), F.lit(trigger).alias("trigger"),
        F.col("storage_path").alias("source_path"),
        F.concat(F.lit(export_dir.rstrip("/") + "/"), F.col("id").cast("string"), F.lit("_"), name).alias("export_path"),
        iso_utc(as_of).alias("exported_at"))


def export_audit(exported: DataFrame, actor: str, as_of: Column) -> DataFrame:
    return exported.select(
        "document_id", F.lit("approved_exported").alias("action"), F.lit(actor).alias("actor"),
        F.concat(F.lit("status="), F.col("status"), F.lit(" trigger="), F.col("trigger"),
                 F.lit(" path="), F.col("export_path")).alias("details"), as_of.alias("created_at"))


def write_export(metadata: DataFrame, content: DataFrame, path: str, run: str) -> None:
    """Metadata as JSON and content as Parquet under ``path``, in a folder of this ``run``.

    Earlier runs stay; the same run again replaces only itself. ``read_export`` gives the last
    export of each document. Content: document_id, content.
    """
    metadata.write.mode("overwrite").json(f"{path}/metadata/run={run}")
    kept = content.join(metadata.select("document_id", "export_path"), "document_id", "inner")
    kept.write.mode("overwrite").parquet(f"{path}/content/run={run}")


def last_run(df: DataFrame, key: str) -> DataFrame:
    """Of rows written by several runs the ones of each key's last run: runs named by numbers in their order, after all
    others, and those in the order of their names (times as ISO text sort so)."""
    order = F.struct(F.col("run").try_cast("decimal(38,0)").alias("number"), F.col("run").alias("name"))
    return df.join(df.groupBy(F.col(key).alias("__key")).agg(F.max(order)["name"].alias("__run")),
                   F.col(key).eqNullSafe(F.col("__key")) & (F.col("run") == F.col("__run")), "left_semi")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and content of all exported documents, each as last exported."""
    metadata = spark.read.schema(METADATA).json(f"{path}/metadata")
    content = spark.read.option("basePath", f"{path}/content").parquet(f"{path}/content").withColumn("run", F.col("run").cast("string"))
    return last_run(metadata, "document_id"), last_run(content, "document_id")


def csv_rows(docs: DataFrame) -> DataFrame:
    """The seven export columns as text, missing values empty."""
    def shown(name: str) -> Column:
        col = iso_utc(F.col(name)) if name == "due_date" else F.col(name).cast("string")
        return F.coalesce(col, F.lit("")).alias(name)

    return docs.select(*[shown(c) for c in CSV_COLUMNS])


def csv_lines(docs: DataFrame) -> DataFrame:
    """The same as quoted CSV lines, one per document."""
    rows = csv_rows(docs)
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns]
    return rows.select("id", F.concat_ws(",", *quoted).alias("line"))


def write_csv(docs: DataFrame, path: str) -> None:
    (csv_rows(docs).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("emptyValue", "")
     # The writer would otherwise trim every value.
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_processed_copy(files: DataFrame, statuses: DataFrame, path: str, run: str) -> None:
    """Content of processed files by final status, in a folder of this ``run``. Files: id, filename, content.

    Earlier runs stay; the same run again replaces only itself.
    """
    files.join(statuses.select("id", "status"), "id", "inner").write.mode("overwrite").partitionBy("status").parquet(f"{path}/run={run}")


def read_processed_copies(spark: SparkSession, path: str) -> DataFrame:
    """Every processed file under its last status."""
    return last_run(spark.read.parquet(path).withColumn("run", F.col("run").cast("string")), "id")


def append_log(rows: DataFrame, path: str, batch: str, ts_col: str = "created_at") -> None:
    """Append to a log partitioned by day, so that retention drops partitions.

    The rows of a ``batch`` have partitions of their own, which the same batch replaces if it runs again.
    """
    placed = rows.withColumn("day", F.to_date(ts_col)).withColumn("batch", F.lit(batch))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
