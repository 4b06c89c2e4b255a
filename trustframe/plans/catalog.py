"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the given tables (or tables
Spark derives from them) in full, and returns a DataFrame whose columns are
named exactly as in the oracle SQL.  Doubles that the oracle recomputes are
rounded to 6 places with the engine-independent ``round_half``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from trustframe.plans import queries_eval, queries_more, queries_ops, queries_registry  # noqa: F401
