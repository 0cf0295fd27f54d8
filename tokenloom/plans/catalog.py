"""The registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from . import pages_catalog, scoring_catalog, sessions_catalog, stored_catalog

QUERIES = pages_catalog.QUERIES | sessions_catalog.QUERIES | scoring_catalog.QUERIES | stored_catalog.QUERIES
ORACLE_SQL = pages_catalog.ORACLE_SQL | sessions_catalog.ORACLE_SQL | scoring_catalog.ORACLE_SQL | stored_catalog.ORACLE_SQL
