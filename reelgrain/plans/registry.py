"""The registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelgrain.storage import scoped

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module with the equivalent SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return keep


def _modules() -> list[Registry]:
    from importlib import import_module
    from pkgutil import iter_modules

    import reelgrain.plans as plans

    found = [import_module(f"reelgrain.plans.{m.name}") for m in iter_modules(plans.__path__) if m.name.startswith("q_")]
    return [m.QUERIES for m in found]


def queries() -> dict[str, Query]:
    return {name: scoped(q) for r in _modules() for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in _modules() for name, s in r.sql.items()}
