"""All queries by name, and their SQL."""

from __future__ import annotations

from tidelog.plans import logs, records, stores

QUERIES = logs.QUERIES | stores.QUERIES | records.QUERIES
SQL: dict[str, str] = logs.SQL | stores.SQL | records.SQL
