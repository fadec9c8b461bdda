"""Core query registry: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def deco(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return deco


def r6(x: Column | str) -> Column:
    """Rounded to six places for the comparison with SQL; the tiny shift keeps ties from rounding differently."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-10), 6)


def s6(x: str) -> str:
    """The same in SQL."""
    return f"round(CAST({x} AS DOUBLE) + 1e-10, 6)"
