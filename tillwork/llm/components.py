"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import stash


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def roots(links: DataFrame) -> DataFrame:
    """The smallest node each node can reach: columns ``node``, ``root``.

    ``links`` has two long columns ``a``, ``b``; direction, repeats and self-links do not
    matter; only nodes of a link to another node are returned, the root itself not. Each
    round writes the links, which are never more than they were; the driver sees two
    numbers. The joins stay plain, so that AQE splits a node with very many neighbours.
    """
    links = stash(links.filter("a != b").distinct(), "links")
    mark = None
    while True:
        links = stash(_small_star(_large_star(links)).filter("a != b").distinct(), "links")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
