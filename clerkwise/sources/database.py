"""External databases as DataFrames, read only."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clerkwise.operators.imports import check_query

JDBC_SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "postgresql+psycopg2": "postgresql",
                "mysql": "mysql", "mysql+pymysql": "mysql"}


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A checked SELECT from PostgreSQL or MySQL (JDBC) or a SQLite file.

    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    split the read, for every kind of database.
    """
    select = check_query(spark, query).rstrip(";")
    scheme = url.split("://", 1)[0].lower() if "://" in url else "sqlite"
    if scheme in JDBC_SCHEMES:
        target = f"jdbc:{JDBC_SCHEMES[scheme]}://{url.split('://', 1)[1]}"
        reader = spark.read.format("jdbc").option("url", target)
        # A partitioned JDBC read takes a derived table in place of a query.
        key, value = ("dbtable", f"({select}) q") if "partitionColumn" in options else ("query", select)
        return reader.option(key, value).options(**options).load()
    if scheme == "sqlite":
        spark.dataSource.register(SQLiteSource)
        return spark.read.format("sqlite_select").option("path", sqlite_path(url)).option("query", select).options(**options).load()
    raise ValueError("Unsupported database URL scheme. Supported: sqlite, postgresql, mysql.")


def sqlite_path(url: str) -> str:
    lowered = url.strip().lower()
    for prefix in ("sqlite:///", "sqlite://"):
        if lowered.startswith(prefix):
            url = url.strip()[len(prefix):]
            break
    path = unquote(url).strip()
    if not path or path == ":memory:":
        raise ValueError("In-memory SQLite databases are not supported for imports.")
    return path


class _Range(InputPartition):
    def __init__(self, condition: str | None):
        self.condition = condition


class SQLiteSource(DataSource):
    """SELECT over a SQLite file on a shared path, split on a numeric column as the JDBC source does.

    SQLite gives each value its own type. A column gets the widest that occurs in any row: text, else binary, else double,
    else bigint.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_select"

    def schema(self) -> str:
        with _connect(self.options["path"]) as connection:
            names = [c[0] for c in connection.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").description]
            quoted = ['"' + n.replace('"', '""') + '"' for n in names]
            ranks = ", ".join(f"max(CASE typeof({q}) WHEN 'text' THEN 4 WHEN 'blob' THEN 3 WHEN 'real' THEN 2 WHEN 'integer' THEN 1 ELSE 0 END)" for q in quoted)
            widest = connection.execute(f"SELECT {ranks} FROM ({self.options['query']})").fetchone()
        kinds = {None: "string", 0: "string", 1: "bigint", 2: "double", 3: "binary", 4: "string"}
        return ", ".join(f"`{n}` {kinds[v]}" for n, v in zip(names, widest, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return _SQLiteReader(dict(self.options), schema)


class _SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.query = options["path"], options["query"]
        lowered = {k.lower(): v for k, v in options.items()}
        self.column = lowered.get("partitioncolumn")
        self.count = int(lowered.get("numpartitions", 1))
        self.low, self.high = (int(lowered.get(k, 0)) for k in ("lowerbound", "upperbound"))
        self.kinds = [f.dataType.simpleString() for f in schema.fields]

    def partitions(self) -> list[_Range]:
        if not self.column or self.count < 2:
            return [_Range(None)]
        width = (self.high - self.low) / self.count
        cuts = [self.low + round(width * i) for i in range(1, self.count)]
        col = '"' + self.column.replace('"', '""') + '"'
        ranges = [f"{col} < {cuts[0]} OR {col} IS NULL"]
        ranges += [f"{col} >= {a} AND {col} < {b}" for a, b in zip(cuts, cuts[1:])]
        return [_Range(c) for c in ranges + [f"{col} >= {cuts[-1]}"]]

    def read(self, partition: _Range) -> Iterator[tuple]:
        where = f" WHERE {partition.condition}" if partition.condition else ""
        cast = {"string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "double": float, "bigint": int,
                "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        with _connect(self.path) as connection:
            for row in connection.execute(f"SELECT * FROM ({self.query}){where}"):
                yield tuple(None if v is None else cast[k](v) for k, v in zip(self.kinds, row))


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
