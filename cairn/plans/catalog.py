"""Queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from . import audit_queries, bundle_queries, diff_queries, export_queries, function_queries, metadata_queries, record_queries

MODULES = [diff_queries, audit_queries, metadata_queries, function_queries, bundle_queries, record_queries, export_queries]
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
