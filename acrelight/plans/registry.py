"""All queries of the domain operators, and their SQL."""

from __future__ import annotations

from acrelight.plans import detail_queries, document_queries, feature_queries, freetext_queries, pipeline, scoring_queries, section_queries, source_queries, stream_queries

MODULES = [scoring_queries, document_queries, feature_queries, freetext_queries, pipeline, source_queries, section_queries, detail_queries, stream_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
