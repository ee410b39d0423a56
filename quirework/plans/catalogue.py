"""Queries by name and their SQL."""

from __future__ import annotations

from . import column_queries, geo_queries, inventory_queries, search_queries, source_queries, text_queries

MODULES = (text_queries, inventory_queries, search_queries, geo_queries, column_queries, source_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
