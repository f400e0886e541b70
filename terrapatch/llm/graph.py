"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import common


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node reachable.

    Alternating steps: each node links its larger neighbours to the smallest of its neighbourhood, then its
    smaller ones. Every round is written to the shared folder in place of the one before, and only sums of the edges come to the driver.
    A node whose neighbourhood is large only ever yields one row for each neighbour.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = common.written(now, "edges")
    seen = None
    while True:
        # large star: every neighbour above u goes to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = common.written(least, "edges")  # so that both sides are dealt out anew, and large parts can be split
        large = both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.written(large.distinct(), "edges")
        common.forgotten(least, now)
        # small star: u and its lower neighbours go to the least of them
        least = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "edges")
        small = large.join(least.hint("shuffle_merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = common.written(small.where("u <> v").distinct(), "edges")
        common.forgotten(least, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
