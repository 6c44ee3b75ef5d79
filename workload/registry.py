"""Name -> Spark query, and name -> the same query as SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add
