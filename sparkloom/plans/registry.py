"""Queries by name, and their SQL."""

from __future__ import annotations


def registry():
    """A dictionary of queries, one of their SQL, and a decorator that adds a function to both."""
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return queries, texts, query
