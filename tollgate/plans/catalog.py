"""The catalogue of runnable queries and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}
VIEWS: dict[str, tuple[list[str], str]] = {}

MODULES = ["views", "request_queries", "vector_queries", "audit_queries", "config_queries", "agent_queries", "document_queries", "image_queries", "stream_queries"]


def view(name: str, body: str, needs: str = "") -> None:
    """A derived table for the check SQL: ``body`` may use the views in ``needs``."""
    VIEWS[name] = (needs.split(), body)


def with_views(body: str, needs: str = "", replaced: dict[str, tuple[str, str]] | None = None) -> str:
    """``body`` behind a WITH clause that defines the views it needs.

    ``replaced`` gives other definitions, ``(needs, body)``, to some of them.
    """
    order: list[str] = []
    views = VIEWS | {name: (inner.split(), text) for name, (inner, text) in (replaced or {}).items()}

    def visit(name: str) -> None:
        for inner in views[name][0]:
            visit(inner)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    defined = [f"{name} AS ({views[name][1]})" for name in order]
    if not defined:
        return body
    return "WITH RECURSIVE " + ",\n".join(defined) + "\n" + body


def query(name: str, sql: str | None = None, needs: str = "", replaced: dict[str, tuple[str, str]] | None = None):
    """Register a query, with the SQL that gives the same rows where SQL can express it."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            CHECK_SQL[name] = with_views(sql.strip(), needs, replaced)
        return function

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tollgate.plans.{module}")
