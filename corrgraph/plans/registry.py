"""Names every graph query and the SQL that states its result."""

from __future__ import annotations

from corrgraph.plans import graph_queries, policy_queries, scalar_queries, shape_queries, stream_queries, validate_queries

GROUPS = [graph_queries, validate_queries, policy_queries, shape_queries, stream_queries, scalar_queries]


def queries() -> dict:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
