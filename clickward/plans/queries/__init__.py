"""Registered queries: each operator over the given tables, with its SQL where SQL can say it."""

from clickward.plans.queries.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
