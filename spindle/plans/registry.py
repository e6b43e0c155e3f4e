"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(df: DataFrame, digits: dict[str, int] | int = 6) -> DataFrame:
    """Round double columns, so that the order of additions does not show."""

    def shown(name: str, kind: str) -> str:
        if kind != "double":
            return f"`{name}`"
        return f"round(`{name}`, {digits if isinstance(digits, int) else digits.get(name, 6)}) AS `{name}`"

    return df.selectExpr(*[shown(n, k) for n, k in df.dtypes])
