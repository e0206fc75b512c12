"""Named queries over the given tables."""

from __future__ import annotations

import importlib

GROUPS = [
    "serving_queries", "quality_queries", "registry_queries", "feedback_queries", "audit_queries", "routing_queries",
    "notebook_queries", "sql_queries", "stream_queries",
]


def load():
    """(queries, check SQL) of all groups."""
    from modelwarden.plans import catalog

    for group in GROUPS:
        importlib.import_module(f"modelwarden.plans.{group}")
    return dict(catalog.QUERIES), dict(catalog.CHECK_SQL)
