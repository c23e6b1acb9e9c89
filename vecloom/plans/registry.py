"""Registry of the named queries: a Spark callable and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(value: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def sql_r6(value: str) -> str:
    return f"(round(CAST({value} AS DOUBLE), 6) + 0.0)"


def sql_uniform(key: str, seed: str) -> str:
    digest = f"md5(CAST({key} AS VARCHAR) || ':' || '{seed}')"
    return f"(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) / 4294967296.0)"


def sql_salt(key: str, buckets: int = 4096, seed: str = "salt") -> str:
    digest = f"md5(CAST({key} AS VARCHAR) || ':' || '{seed}')"
    return f"(CAST('0x' || substr({digest}, 1, 4) AS BIGINT) * {buckets} // 65536)"
