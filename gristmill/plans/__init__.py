"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import full, more, page_tree  # noqa: F401  they register their queries
from .catalog import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
