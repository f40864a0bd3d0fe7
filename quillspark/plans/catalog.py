"""Registry of the engine's queries: name, Spark form and DuckDB form."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: file a query under ``name``, with its DuckDB SQL where there is one."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return add


MODULES = ("analytics", "retrieval", "questions", "indexes", "knowledge", "quality", "sessions", "graphs", "learning", "versions", "texts", "documents", "tools", "answers", "upkeep", "streams", "substrate")


def _load() -> None:
    for name in MODULES:
        import_module(f"quillspark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
