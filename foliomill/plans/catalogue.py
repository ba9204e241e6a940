"""Queries by name, and the SQL that says what each must give."""

from __future__ import annotations

from foliomill.plans import core_queries, package_queries, text_queries

QUERIES = {**text_queries.QUERIES, **core_queries.QUERIES, **package_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **core_queries.ORACLE_SQL, **package_queries.ORACLE_SQL}
