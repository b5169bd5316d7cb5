"""Registered queries and the SQL each is checked against."""

from tidebook.catalog.registry import ORACLE, QUERIES, oracle_sql, queries

__all__ = ["ORACLE", "QUERIES", "oracle_sql", "queries"]
