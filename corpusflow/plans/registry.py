"""Registry of checked queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix from CTE bodies."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
