"""All registered queries and their SQL, without the corpus operators."""

from __future__ import annotations

from peptora.plans import filed, scalar, tables, windows

QUERIES = scalar.QUERIES | windows.QUERIES | tables.QUERIES | filed.QUERIES
ORACLE_SQL = scalar.SQL | windows.SQL | tables.SQL | filed.SQL
