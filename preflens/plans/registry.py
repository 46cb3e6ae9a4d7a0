"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the equivalent SQL where there is one."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def r6(column: Column | str) -> Column:
    """Six decimals: engines add floats up in different orders."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})
