"""Registered queries: every operator run on the given tables, with its SQL twin where SQL can say it."""

from hazegrid.catalog.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
