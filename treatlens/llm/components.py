"""Connected components by star contraction: labels travel along links, never to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.session import cut_lineage


def _to_smallest(links: DataFrame) -> DataFrame:
    """``(a, low)``: the smallest of a node and its neighbours; combined before the shuffle."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links (a, b)``; the component is its smallest node.

    Alternates large stars (every larger neighbour is tied to the smallest one)
    and small stars (a node and its smaller neighbours are tied to the smallest)
    until each component is one star; the number of rounds grows with the
    logarithm of its size. A hub is one row per link in a join that adaptive
    execution can split. Self-links and repeated links are harmless.
    """
    links = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links"
    )
    mark = None
    while True:
        both = _both(links)
        large = (
            both.join(_to_smallest(both), "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        # All links now lead from a node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a <> b")
            .unionByName(low.select("a", F.col("low").alias("b")))
            .distinct()
        )
        links = cut_lineage(small, "links")
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
