"""Connected components of an edge table by alternating large-star and small-star steps.

Everything stays distributed: each step is a grouped minimum (summed up before the shuffle) and a join, each round is written to the shared folder
and the round before it deleted. A hub's links are joined where they are: nodes with more than 1 / ``HUBS`` of all links are at most ``HUBS``, so their
minima are broadcast, whatever the size of the graph; the others go through an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

HUBS = 10_000


def hub_join(rows: DataFrame, key: str, summary: DataFrame, total: int) -> DataFrame:
    """rows with the columns of summary (key, n, ...), whose n is the number of rows of each key, total in all."""
    limit = total // HUBS + 1
    hubs = summary.where(F.col("n") > limit).drop("n")  # at most HUBS rows: their n add up to total at most
    others = summary.where(F.col("n") <= limit).drop("n")
    direct = rows.join(F.broadcast(hubs), key)
    return direct.unionByName(rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: (u, v), u > v, distinct, total of them. Large: bind the larger neighbours of a node to its least; small: the smaller ones."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        bound = hub_join(around, "u", least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        bound = hub_join(edges, "u", least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return bound.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of any direction to (node, root): root is the least node reachable; nodes without links have no row.

    Raises if it has not settled after max_rounds (the method needs a logarithmic number).
    """
    spark = edges.sparkSession
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    state = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        bound = materialize(_star(links, True, now[0]), "links")
        discard(spark, links)
        links = materialize(_star(bound, False, bound.count()), "links")
        discard(spark, bound)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
