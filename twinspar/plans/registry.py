"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from . import curation_queries, feature_queries, nested_queries, similarity_queries

FLAGSHIP = "mrr_recall_cosine"
_MODULES = (nested_queries, curation_queries, similarity_queries, feature_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
