"""Registered queries.

``core_queries`` / ``core_oracles`` hold the queries of the core; the text operators
register theirs in ``tracewright.llm.queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Name -> query and, where SQL can state it, name -> oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep


core = Registry()


def load_core() -> Registry:
    """Import the modules that register core queries and return the registry."""
    import importlib

    for module in ("nested", "traces", "verification", "graphs", "lookups", "joins", "runs", "models", "files"):
        importlib.import_module(f"{__name__}.{module}")
    return core
