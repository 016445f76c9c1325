"""Queries by name and their SQL twins."""

from __future__ import annotations

from skein.plans import contract_queries, document_queries, metric_queries, report_queries, segment_queries, store_queries, text_queries, workflow_queries

_ALL = {**segment_queries.QUERIES, **text_queries.QUERIES, **metric_queries.QUERIES, **workflow_queries.QUERIES, **document_queries.QUERIES, **report_queries.QUERIES, **store_queries.QUERIES, **contract_queries.QUERIES}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
