"""All registered queries."""

from __future__ import annotations

from clerkwise.plans import analytics_queries, change_queries, document_queries, stream_queries  # noqa: F401
from clerkwise.plans.catalog import catalog, runner


def queries() -> dict:
    return {name: runner(query) for name, query in catalog.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for name, query in catalog.queries.items() if query.sql}
