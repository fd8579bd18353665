"""Registration of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: White space of all scripts, as a class that RE2 knows.
W = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
TRIM = f"'^{W}+|{W}+$', '', 'g'"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def stamp(name: str) -> str:
    """DuckDB: a time as UTC text."""
    return f"strftime(timezone('UTC', {name}), '%Y-%m-%d %H:%M:%S')"
