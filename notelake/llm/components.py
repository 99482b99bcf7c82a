"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the edges (a, b): component is the smallest id reachable.

    Rounds of large and small stars, each written, until nothing changes: a large star links each larger neighbour
    of a node to the smallest node next to it, a small star each smaller one. Each round leaves at most as many edges as
    before, and the number of rounds is about the logarithm of the longest shortest path. A hub's row is never
    gathered in one task: only minima are joined to edges, and Spark may split a joined hub. Only counts reach the driver.
    No edges give no rows; loops and repeated edges don't matter.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # now every edge leads down; a node's others, and itself, go to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(others.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large)
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A number of the edges and two sums of 64-bit hashes of them: the same only for the same edges."""
    one, other = F.xxhash64("u", "v"), F.xxhash64("v", F.lit(7), "u")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum(F.shiftright(other, 20))).first())
