"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over the edges; nothing is collected but one
(count, checksum) row, and the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphflow.scratch import Scratch

#: Edges up to which one task holds all neighbours of a hub.
HUB = 1_000_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    near = _both(edges)
    low = split(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return near.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = split(down.groupBy("u").agg(F.min("v").alias("m")))
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node that it reaches.

    ``edges`` has the columns a, b of one orderable type; direction, loops and repeats don't matter,
    rows with a null end are left out. Nodes without an edge to another node are not returned. Rounds go on to the fixed point,
    which every graph has: no round makes a node's smallest neighbour larger.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.keep(edges.select("a", "b").where("a <> b").distinct())
    many = now.count() > HUB
    state = None
    while True:
        made: list[DataFrame] = []

        def split(df: DataFrame, made: list[DataFrame] = made) -> DataFrame:
            """Minima of many edges are written before they are joined: the join's sides are then plain exchanges, and a hub's side is split."""
            if many:
                made.append(scratch.keep(df))
            return made[-1] if many else df

        large = _large_star(now, split)
        if many:
            made.append(scratch.keep(large))
            large = made[-1]
        new = scratch.keep(_small_star(large, split))
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(now, *made)
        now = new
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
