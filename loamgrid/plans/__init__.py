"""Queries on the driver's tables, each with the SQL it is checked with."""

from __future__ import annotations

from .registry import ORACLE, QUERIES, Query


def _load() -> None:
    from . import chunk_queries, file_queries, header_queries, surface_queries, text_queries, volume_queries  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
