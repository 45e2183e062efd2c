"""Connected components of a link table, by alternating large and small stars.

A round links every node's larger neighbours, then all its smaller ones, to the smallest node it
sees. Rounds are minima per node, which combine before the shuffle, and joins on the node, which
Spark splits where a node is a hub. Nothing is collected; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import stage


def _minima(links: DataFrame) -> DataFrame:
    # Written out, so that the join with it shuffles both sides itself and Spark can split a hub's rows.
    return stage(links.groupBy("u").agg(F.min("v").alias("low")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) of all nodes but each component's smallest, which is the component.

    Links are undirected and may repeat; links of a node to itself and links with nulls are left out.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = stage(links.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    before = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _minima(both).select("u", F.least("u", "low").alias("low"))
        large = both.join(near, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("low")))
        large = large.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = _minima(large)
        small = large.join(least, "u")
        small = small.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = stage(small.unionAll(least.select("u", F.col("low").alias("v"))).distinct())
        after = _mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
