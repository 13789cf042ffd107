"""All registered queries of the extraction engine and their DuckDB forms."""

from __future__ import annotations

from quirelake.plans import document_queries, format_queries, page_queries, text_queries

_PARTS = (text_queries, document_queries, page_queries, format_queries)

QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
