"""Imports every module of queries, so that the registry is full."""

from quarry.plans import archive_queries, context_queries, ingest_queries, report_queries, scope_queries, search_queries, synthesis_queries  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
