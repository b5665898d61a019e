"""SQL text of literals. One parsed expression replaces hundreds of calls into
the JVM when a rule table becomes part of a plan."""

from __future__ import annotations

from collections.abc import Iterable


def string_literal(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS string)"
    body = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{body}'"


def string_array(items: Iterable[str]) -> str:
    inner = ", ".join(string_literal(item) for item in items)
    return f"array({inner})" if inner else "CAST(array() AS array<string>)"
