"""Registry of queries and of their DuckDB counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def query(name: str, tables: str, sql: str | None = None):
    """Register ``f(*tables)`` as a query; ``sql`` gives the same rows in DuckDB."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(load(spark, sf_dir, t) for t in tables.split()))
        if sql:
            ORACLES[name] = sql
        return f

    return register
