"""All queries of the package, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from veilmark.plans import audit_queries, corpus_queries, leak_queries, stats_queries, study_queries

QUERIES = {**leak_queries.QUERIES, **stats_queries.QUERIES, **corpus_queries.QUERIES, **study_queries.QUERIES, **audit_queries.QUERIES}
SQL = {**leak_queries.SQL, **stats_queries.SQL, **corpus_queries.SQL, **study_queries.SQL, **audit_queries.SQL}
