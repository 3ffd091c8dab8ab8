"""The library's named queries over the test tables, with their SQL."""

from __future__ import annotations

from tidemark.plans import queries_changes, queries_index, queries_policy, queries_quality, queries_retrieval
from tidemark.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_context"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "queries_changes", "queries_index", "queries_policy", "queries_quality", "queries_retrieval"]
