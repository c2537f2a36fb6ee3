"""Registered queries: each operator on the given tables, beside the SQL it must equal."""

from cohortlab.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
