"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(pairs: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One star operation on pairs (u, v): every v moves to the smallest neighbour of u.

    The smallest neighbours are a table of their own, so that the join that follows reads two plain exchanges and Spark
    can split the partition of a node with very many neighbours.
    """
    least = scratch.cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    met = pairs.join(least, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    moved = moved.where("u > v")
    out = scratch.cut(moved if large else moved.distinct())  # a large star makes no more rows than it reads
    scratch.drop(least)
    return out


def contracted(edges: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """Pairs (u, v), u > v, with the components of edges (u, v), after some rounds of both stars.

    Without a number of rounds, until every u has one v, its component's smallest node. After fewer, the smallest v of a
    u still is a node that u is connected with. Loops and repeated or reversed edges are allowed; nodes are longs without
    nulls. No round gathers the neighbours of a node in one place.
    """
    now = scratch.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    done = 0
    while done < rounds if rounds is not None else not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, scratch, True)
        small = _star(wide, scratch, False)
        scratch.drop(wide, now)
        now, done = small, done + 1
    return now


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is its smallest node.

    The number of rounds grows with the logarithm of the longest path.
    """
    now = contracted(edges, scratch)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every u has one v and no u is a v of another: then each v is the smallest node of its component."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
