"""Connected components of an edge table by alternating star contraction, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, small

#: Nodes up to this number are broadcast (some 16 bytes each); more are joined by shuffle.
BROADCAST_NODES = 400_000


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free digest, which tell whether a round changed anything."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (columns u and v): root is the smallest node that it hangs together with.

    Each round hangs the larger neighbours of every node on its smallest one (large star), then the smaller neighbours
    too (small star). A round is one minimum for each node, found on the map side first, and one join with it. Minima are
    written before they are joined: few are broadcast, and of many Spark's adaptive joins can split a hub's neighbours,
    as both sides are plain shuffles. Rounds grow with the logarithm of the longest chain; each is written to the checkpoint folder. Loops only
    (u = v), nulls and repeated edges are harmless; a table without proper edges gives an empty table.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(small(least, BROADCAST_NODES), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(small(lower, BROADCAST_NODES), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(hung.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(after)
        now = after
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
