"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored


def _least(links: DataFrame) -> DataFrame:
    """node, least: the smallest of a node and its neighbours. Partial minima are taken before the shuffle."""
    return links.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("least"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger neighbours (large) or smaller neighbours and itself (small) on its least neighbour."""
    if large:
        both = links.select("node", "other").union(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        hung = both.join(_least(both), "node").where(F.col("other") > F.col("node")).select(F.col("other").alias("node"), F.col("least").alias("other"))
    else:
        down = links.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
        moved = down.join(_least(down), "node")
        hung = moved.select(F.explode(F.array("node", "other")).alias("node"), F.col("least").alias("other"))
    return hung.where("node <> other").distinct()


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node of its component) of every linked node. links: node, other (long).

    Each round is written to the shared folder, so rounds neither grow the lineage nor depend on one executor. The
    number of rounds grows with the logarithm of the longest chain. Links to itself and repeated links change nothing;
    an empty table has no components.
    """
    links = stored(links.where("node <> other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct())
    before = _sign(links)
    while before[0]:
        links = stored(_star(stored(_star(links, True)), False))
        now = _sign(links)
        if now == before:
            break
        before = now
    stars = links.groupBy("node").agg(F.min("other").alias("component"))
    roots = stars.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.unionByName(roots)
