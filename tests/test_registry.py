import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, alike, normal
from clerkwise.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["department", "total", "needs_review", "ready"] and out.count() > 0


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    want = pd.DataFrame(result.fetchall(), columns=columns, dtype=object)
    assert sorted(frame.columns) == sorted(columns)
    assert all(alike(kind, kinds[c]) for c, kind in frame.dtypes), (frame.dtypes, kinds)
    assert normal(got) == normal(want)
