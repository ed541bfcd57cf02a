"""Registry of named queries: a Spark callable and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxledger import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None, fx: tuple[str, ...] = ()) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = with_fixtures(sql, fx)


def with_fixtures(sql: str, fx: tuple[str, ...]) -> str:
    """Prefix the SQL with the fixtures it reads; its own CTEs follow after ``WITH``."""
    ctes = [f"{name} AS ({fixtures.oracle_text(name)})" for name in fx]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(ctes + [body[5:].strip()])
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def rnd(c: Column | str) -> Column:
    """Six decimals as in the oracle texts, see ``sqlkit.r6``."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1.3e-10), 6)


def fx(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: fixtures.load(spark, sf, name)
