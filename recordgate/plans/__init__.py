"""Queries over the given tables, by operator id."""

from . import batch_queries, file_queries, format_queries, gate_queries, migration, registry, row_queries, set_queries, sheet_queries  # noqa: F401

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
