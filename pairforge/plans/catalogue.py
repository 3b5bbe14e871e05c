"""All queries of the core by name, with their DuckDB SQL."""

from __future__ import annotations

from . import copies, files, ingest, statistics, whole

PARTS = [copies, files, ingest, statistics, whole]


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
