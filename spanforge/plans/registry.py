"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from spanforge.plans import corpus_queries, model_queries, more_queries

QUERIES: dict = corpus_queries.QUERIES | model_queries.QUERIES | more_queries.QUERIES
ORACLE: dict = corpus_queries.ORACLE | model_queries.ORACLE | more_queries.ORACLE
