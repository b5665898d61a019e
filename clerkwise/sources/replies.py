"""Connectors as data sources: stored API replies, one page a partition.

``spark.read.format("connector_replies")`` and ``spark.readStream`` of the same read the reply pages of one connector from a
folder ``connector_type=T/fetched=SECONDS/``, one JSON reply a line. A page (a file) is a partition, so the pages of a listing are read side by
side; a filter on ``fetched`` leaves out the folders that it rules out before they are listed. As a stream, the offset is the time of the
last sync: a run goes on with the folders fetched after it.

A connector type is a class with a name, a listing over the replies (``sources.connectors``) and what its listing needs. ``register_connectors``
makes the source known to a session; ``list_connector`` reads the external documents of a type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from clerkwise.sources import connectors
from clerkwise.sources.files import file_system

FORMAT = "connector_replies"
SCHEMA = "fetched bigint, page string, payload string"


@dataclass(frozen=True)
class Connector:
    """What is needed to list the external documents of one type: how a stored reply reads, and the options of its listing."""

    name: str
    listing: Callable[..., DataFrame]
    options: tuple[str, ...] = field(default=())


# Connector types by name; add to extend.
REGISTRY: dict[str, Connector] = {c.name: c for c in (
    Connector("servicenow", connectors.servicenow, ("base_url",)),
    Connector("confluence", connectors.confluence, ("base_url",)),
    Connector("jira", connectors.jira),
    Connector("salesforce", connectors.salesforce, ("instance_url", "version")),
    Connector("sharepoint", connectors.sharepoint, ("site_url", "library")),
)}


@dataclass
class Page(InputPartition):
    fetched: int
    path: str


class _Store:
    """The folders and pages of one connector in a file system that pyarrow reaches (local, HDFS, S3, GCS)."""

    def __init__(self, options: dict):
        lowered = {k.lower(): v for k, v in options.items()}
        if lowered.get("connector") not in REGISTRY:
            raise ValueError(f"Unknown connector type: {lowered.get('connector')}")
        self.root = f"{lowered['path'].rstrip('/')}/connector_type={lowered['connector']}"

    def _open(self):
        return file_system(self.root)

    def folders(self) -> list[int]:
        from pyarrow import fs

        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name.removeprefix("fetched=")) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("fetched="))

    def pages(self, fetched: int) -> list[Page]:
        from pyarrow import fs

        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(f"{root}/fetched={fetched}"))
        return [Page(fetched, f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size]

    def read(self, page: Page) -> Iterator[tuple]:
        system, _ = self._open()
        name = page.path.rsplit("/", 1)[-1]
        with system.open_input_stream(page.path) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    if line.strip():
                        yield page.fetched, name, line.decode()
            if rest.strip():
                yield page.fetched, name, rest.decode()


class ReplyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.store, self.tests = _Store(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``fetched`` with a number are decided here; all others go back to Spark."""
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for one in filters:
            if type(one) in kinds and one.attribute == ("fetched",):
                self.tests.append((kinds[type(one)], one.value))
            else:
                yield one

    def _wanted(self, fetched: int) -> bool:
        return all(fetched == v if kind == "=" else fetched > v if kind == ">" else fetched >= v for kind, v in self.tests)

    def partitions(self) -> list[Page]:
        return [page for fetched in self.store.folders() if self._wanted(fetched) for page in self.store.pages(fetched)]

    def read(self, partition: Page) -> Iterator[tuple]:
        # A source without pages has one empty partition.
        return self.store.read(partition) if partition is not None else iter(())


class ReplyStreamReader(DataSourceStreamReader):
    """The offset is the time of the last sync; a batch holds the folders fetched after it."""

    def __init__(self, options: dict):
        self.store = _Store(options)
        self.start = int({k.lower(): v for k, v in options.items()}.get("since", -1))

    def initialOffset(self) -> dict:
        return {"last_sync": self.start}

    def latestOffset(self) -> dict:
        return {"last_sync": max([self.start, *self.store.folders()])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [page for fetched in self.store.folders() if start["last_sync"] < fetched <= end["last_sync"] for page in self.store.pages(fetched)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.store.read(partition)


class ReplySource(DataSource):
    """Reply pages of one connector. Options: path, connector and, for a stream, since (the last sync known)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReplyReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReplyStreamReader(dict(self.options))


def register_connectors(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReplySource)


def list_connector(spark: SparkSession, name: str, path: str, since: int | None = None, **options) -> DataFrame:
    """External documents of a connector type from its stored replies; ``since`` reads only replies fetched after that time."""
    if name not in REGISTRY:
        raise ValueError(f"Unknown connector type: {name}")
    odd = set(options) - set(REGISTRY[name].options)
    if odd:
        raise ValueError(f"{name} has no option {sorted(odd)[0]}")
    replies = spark.read.format(FORMAT).option("path", path).option("connector", name).load()
    if since is not None:
        replies = replies.filter(replies.fetched > since)
    return REGISTRY[name].listing(replies.select("payload"), **options)
