"""Names for helper columns that no given table has."""

from __future__ import annotations

from collections.abc import Iterable


def free_prefix(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column name starts with it (letter case aside)."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(wanted.lower()) for c in taken):
        wanted = "_" + wanted
    return wanted
