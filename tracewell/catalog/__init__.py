"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib

from tracewell.catalog.registry import ORACLE, QUERIES, Query

MODULES = (
    "metric_queries",
    "dashboard_queries",
    "mapping_queries",
    "corpus_queries",
    "ledger_queries",
    "file_queries",
)


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return the registry: (queries, oracle SQL)."""
    for module in MODULES:
        importlib.import_module(f"tracewell.catalog.{module}")
    return QUERIES, ORACLE
