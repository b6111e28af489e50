"""Where the registered queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with the given text columns replaced by their SHA-256, named <column>_sha256."""
    return rows.select(*[c for c in rows.columns if c not in columns], *[F.sha2(c, 256).alias(f"{c}_sha256") for c in columns])
