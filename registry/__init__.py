"""Registered queries: every operator run over the given tables, with its SQL counterpart."""

from registry import columns_queries, core_queries, lookup_queries, metric_queries, source_queries, stream_queries  # noqa: F401
from registry.core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
