"""Queries p2_ to p8_ and their SQL."""

from __future__ import annotations

from . import leaks_queries, mixing_queries, oracle, overlap_queries, setjoin_queries, sentences_queries, splits_queries, termfreq_queries

_MODULES = (overlap_queries, setjoin_queries, termfreq_queries, splits_queries, leaks_queries, mixing_queries, sentences_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()} | oracle.SQL
