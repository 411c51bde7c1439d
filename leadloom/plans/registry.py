"""Collects the queries of the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MODULES = [
    "text_queries", "page_queries", "scoring_queries", "search_queries", "crawl_queries",
    "profile_queries", "match_queries", "company_queries", "store_queries",
    "conversation_queries", "event_queries", "hook_queries", "run_queries",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows in plain SQL."""
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"leadloom.plans.{m}")
    return dict(_QUERIES), dict(_SQL)
