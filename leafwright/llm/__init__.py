"""Operators for preparing training data. Nothing outside this subpackage imports it."""

from leafwright.llm.entries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
