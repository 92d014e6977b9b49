"""Catalogue of queries on the driver tables, with their SQL."""

from __future__ import annotations

from . import boards, models, parts, prepared, scores  # noqa: F401  registers the queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
