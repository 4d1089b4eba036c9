"""Registry of checked queries: a Spark function over a data folder and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from checks.views import Tables, duck

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, folder):
            return fn(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn

    return register
