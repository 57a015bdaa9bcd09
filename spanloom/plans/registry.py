"""All queries of the span-label engine and their SQL."""

from __future__ import annotations

from spanloom.plans import evaluation_queries, label_queries, relabel_queries, store_queries, text_queries

FLAGSHIP = "class_metrics"
_MODULES = (text_queries, label_queries, store_queries, evaluation_queries, relabel_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
