"""Name -> query and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Key that deals a table's rows evenly.
ROW_KEYS = {"part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of short rows on all cores, for queries that do much with each row."""
    return spread(table(spark, sf, name), ROW_KEYS[name])
