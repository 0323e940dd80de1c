"""Connected components of a graph of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.session import written


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """The smallest neighbour of each node, itself included; combined before the shuffle."""
    return edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that links (u, v) lead to.

    Each round moves every node's links to its smallest neighbour: first those
    of larger neighbours, then those of smaller ones. When nothing changes,
    each node hangs on its component's smallest node. A node with many links is
    never one group: minima are combined before the shuffle and joined back.
    Nodes without links do not appear; rounds are written to the shared folder.
    """
    edges = written(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both, "u", "v"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = written(large.filter("u <> v").distinct())
        low = _least(large, "u", "v")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = written(small.filter("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
