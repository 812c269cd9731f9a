"""Queries over the given tables, each next to the SQL that states what it must return."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = ("report_queries", "price_queries", "live_queries", "history_queries", "match_queries", "catalog_queries", "quality_queries", "stream_queries", "contract_queries", "feed_queries")


def load() -> SimpleNamespace:
    from checks import registry

    for module in MODULES:
        importlib.import_module(f"checks.{module}")
    return SimpleNamespace(queries=registry.QUERIES, oracles=registry.ORACLES)
