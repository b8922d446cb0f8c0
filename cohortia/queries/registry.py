"""Registry of queries: a Spark callable (spark, folder) -> DataFrame, with an optional ANSI-SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; the SQL twin must give the same columns and values."""
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that summation order does not show; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"
