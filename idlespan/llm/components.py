"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _star(pairs: DataFrame) -> DataFrame:
    """Per ``u`` its smallest neighbour; the aggregate is combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node reachable) for every node of the edges (longs ``u``, ``v``).

    Alternating large-star and small-star steps (Kiveris et al., 2014): rounds grow with the logarithm of the longest path, the
    number of edges never grows, and no node's neighbours are gathered.  Every round is a table in the shared folder.
    Loops and repeated edges are harmless; an empty table of edges gives an empty table.
    """
    now, mark = saved(edges.filter("u != v").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _star(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = (large.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        low = _star(down)
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = saved(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
