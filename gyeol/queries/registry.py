"""A module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracle[fn.__name__] = sql
            return fn

        return add


#: White space in the SQL's regular expressions.
WS = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]+"


def compact(column: str) -> str:
    return f"lower(regexp_replace({column}, '{WS}', '', 'g'))"


def matches(column: str, pattern: str) -> str:
    """Number of matches, 0 for an empty text, null for null."""
    return f"len(regexp_extract_all({column}, '{pattern}'))"
