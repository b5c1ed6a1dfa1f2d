"""The registry of queries and of the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import Relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def named(name: str, sql: str, f: Query) -> None:
    """One of several queries that differ in a parameter."""
    f.__name__ = name
    query(sql)(f)


def rel(spark: SparkSession, d: str, name: str) -> Relation:
    return Relation(spark.read.parquet(f"{d}/{name}.parquet"))
