"""Name -> Spark query, and name -> SQL."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
