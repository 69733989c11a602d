"""Queries on the driver's tables and their SQL."""

from __future__ import annotations

from quirefold.plans import algebra_queries, bibliography_queries, lab_queries, log_queries, note_queries, search_queries, source_queries, store_queries, tex_queries, text_queries

MODULES = (search_queries, log_queries, lab_queries, algebra_queries, note_queries, bibliography_queries, tex_queries, store_queries, source_queries, text_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
