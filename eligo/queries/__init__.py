"""Registered queries of the library and their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from eligo.plans import fixtures

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register fn(v), where v(name) gives a table or view; sql is its DuckDB twin, with views in braces."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: fixtures.view(spark, sf_dir, name))
        if sql:
            ORACLES[fn.__name__] = fixtures.duck(sql)
        return fn

    return add


for _name in ("codes", "parsing", "corpus", "clusters", "metrics", "prediction", "drafting"):
    importlib.import_module(f"eligo.queries.{_name}")
