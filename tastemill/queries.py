"""The registered queries of the recommendation library and their DuckDB twins."""

from __future__ import annotations

from tastemill.plans import analysis, relations, study

# all modules register where relations keeps the tables
QUERIES = relations.QUERIES
ORACLES = relations.ORACLES

__all__ = ["ORACLES", "QUERIES", "analysis", "study"]
