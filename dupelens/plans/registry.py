"""All queries of the engine proper, by name, with their DuckDB equivalents."""

from __future__ import annotations

from .oracle import ORACLE_SQL
from .queries import QUERIES

FLAGSHIP = "recall_rates"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
