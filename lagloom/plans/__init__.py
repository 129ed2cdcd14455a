"""Registered queries with the SQL that gives the same rows, by section."""

from __future__ import annotations

from collections.abc import Callable


def section() -> tuple[dict, Callable]:
    """A table of queries and the decorator that fills it."""
    table: dict = {}

    def query(sql: str | None = None):
        def add(f):
            table[f.__name__] = (f, sql)
            return f

        return add

    return table, query
