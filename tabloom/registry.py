"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.layout import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, folder) under a name, with equivalent SQL where there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Tables of long texts or vectors, where the work per row is large.
HEAVY_TABLES = {"documents", "pages", "conversations", "benchmark", "embeddings"}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return spread(df) if table in HEAVY_TABLES else df
