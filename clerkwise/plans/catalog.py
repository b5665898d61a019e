"""Registry of queries: name, Spark plan, and the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clerkwise.plans.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(build: Callable[[Views], DataFrame]):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = Query(name, build, sql)
            return build

        return keep


catalog = Catalog()


def comparable(df: DataFrame) -> DataFrame:
    """Zone-less times, as the oracle prints them."""
    zoned = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def joined(col: str, separator: str = ","):
    return F.array_join(col, separator)


def runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(query.build(Views(spark, folder)))

    return run
