"""The registered queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from . import aggregate_queries, analysis_queries, finance_queries, lookup_queries, scalar_queries, window_queries

_GROUPS = (scalar_queries, aggregate_queries, lookup_queries, window_queries, finance_queries, analysis_queries)
QUERIES = {k: v for g in _GROUPS for k, v in g.QUERIES.items()}
ORACLE_SQL = {k: v for g in _GROUPS for k, v in g.SQL.items()}
