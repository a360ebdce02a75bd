"""Connected components of a graph of links, by alternating star steps.

Every step is joins and aggregations; links never leave the executors. A node
with very many links is met in partial aggregations and in joins whose skewed
side adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import splittable_join, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node ties its larger (large star) or smaller (small star) neighbours to its least one."""
    if large:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = splittable_join(near, least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, root) for every node with a link; root is the least node of its component.

    ``links``: pairs of nodes in either order; self links and nulls are ignored.
    Ends when a round leaves the stars as they were, after a number of rounds
    that grows with the logarithm of a component's width.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    stars = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # A node under one root each, and no root under another, is a finished forest.
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
        stars = stored(_star(_star(stars, True), False), name)
    roots = stars.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
