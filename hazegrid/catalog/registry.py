"""The query register."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFunction] = {}
_ORACLES: dict[str, str] = {}

_MODULES = [
    "sources",
    "projections",
    "joins",
    "aggregates",
    "windows",
    "rankings",
    "unions",
    "scalars",
    "reports",
    "streams",
    "models",
]


def query(name: str, oracle: str | None = None):
    """Register a function under ``name``, with the SQL that must give the same rows."""

    def register(function: QueryFunction) -> QueryFunction:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"hazegrid.catalog.{module}")


def all_queries() -> dict[str, QueryFunction]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
