from datetime import datetime

from pyspark.sql import functions as F


def one(spark, **columns):
    """A single-row frame to evaluate expressions on."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def column(spark, values, expr, kind="string"):
    """``expr`` of column ``x`` over a list of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def ts(text):
    return datetime.fromisoformat(text)


DOCS = """id string, workspace_id string, filename string, storage_path string, source_channel string, status string,
          doc_type string, department string, urgency string, confidence double, requires_review boolean,
          extracted_fields map<string,string>, missing_fields array<string>, validation_errors array<string>,
          reviewer_notes string, created_at timestamp, updated_at timestamp, due_date timestamp, sla_days int, assigned_to string"""


def docs(spark, *changes):
    """Documents that differ from a plain one in the given columns."""
    base = dict(id="d", workspace_id="w", filename="f.txt", storage_path="s/f.txt", source_channel="upload", status="needs_review",
                doc_type=None, department=None, urgency="normal", confidence=0.5, requires_review=False, extracted_fields={},
                missing_fields=[], validation_errors=[], reviewer_notes=None, created_at=ts("2024-01-01 00:00:00"),
                updated_at=ts("2024-01-02 00:00:00"), due_date=None, sla_days=None, assigned_to=None)
    out = [tuple({**base, "id": f"d{i}", **change}.values()) for i, change in enumerate(changes)]
    return spark.createDataFrame(out, DOCS)
