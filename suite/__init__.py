"""Registered queries: the engine's operators over the given tables, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("cohorts", "scalars", "profiles", "tables", "checks", "reviews", "texts", "catalogue", "decisions", "landing")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its SQL."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"suite.{module}")
