"""The operators of this package on the given tables, as named queries with their SQL twins.

Importing the query modules registers them; ``queries()`` and ``oracles()`` hand out copies.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFunction] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ["web_queries", "document_queries", "dedup_queries", "corpus_queries"]


def query(name: str, oracle: str | None = None):
    """Register a function under ``name``, with the SQL that must give the same rows."""

    def register(function: QueryFunction) -> QueryFunction:
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"hazegrid.llm.{module}")


def queries() -> dict[str, QueryFunction]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
