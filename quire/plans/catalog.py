"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from quire.plans import document_queries, geometry_queries, text_queries

FLAGSHIP = "section_segments"
PARTS = (text_queries, document_queries, geometry_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
