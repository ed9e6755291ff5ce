"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import settled


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    ways = _both_ways(links)
    least = ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (u long, v long); root is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is two joins and two aggregations, and the number of
    rounds grows with the logarithm of the longest chain. Each round is written to the shared folder. Self-links only
    introduce their node. An empty table gives an empty table.
    """
    nodes = links.where("u = v").select("u")
    links = settled(links.where("u <> v").select("u", "v").distinct())
    # Checksums are compared, not counts alone: the star operations keep the number of links nearly fixed.
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = settled(_small_star(_large_star(links).distinct()).distinct())
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    alone = nodes.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return found.union(alone).groupBy("node").agg(F.min("root").alias("root"))
