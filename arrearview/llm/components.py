"""Connected components by alternating large-star and small-star steps over written link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    """Links (a, b) of a written table, each node's larger neighbours tied to its least one. Written, too."""
    both = links.union(links.select("b", "a"))
    least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")))
    star = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    out = written(star.distinct())
    discard(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """The same for each node's smaller neighbours."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("least")))
    moved = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    out = written(moved.union(least).distinct())
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the undirected links (a, b).

    Each step is two joins on a node with its least neighbour. That minimum is pre-aggregated and written before the join,
    so both sides are plain exchanges of tables and a node of any degree is split by the skew join instead of gathering in
    one task. Each step's links are written in the shared folder; the one before is deleted. Without links there are no
    rows.
    """
    links = written(links.filter("a <> b").distinct())
    mark = None
    while True:
        star = _large_star(links)
        step = _small_star(star)
        discard(star)
        now = step.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(links)
        links = step
        if now == mark:
            break
        mark = now
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select(F.col("b"), F.col("b")).distinct())
