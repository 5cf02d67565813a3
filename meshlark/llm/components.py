"""Connected components over an edge table, by hooking and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) with v < u -> (u, root): the smallest vertex reachable from u; roots have no row.

    Each round takes every vertex's least neighbour as its parent, hooks its other neighbours to that parent, and
    lets each vertex skip to its parent's parent. Rounds grow with the logarithm of the longest path.
    """
    edges = saved(edges.select("u", "v").distinct(), "cc-edges")
    while True:
        parent = saved(edges.groupBy("u").agg(F.min("v").alias("p")), "cc-parents")
        hooked = edges.join(parent, "u").filter("v > p").select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(True).alias("moved"))
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = parent.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("moved"))
        after = saved(hooked.unionByName(jumped).groupBy("u", "v").agg(F.max("moved").alias("moved")), "cc-round")
        if after.filter("moved").isEmpty():
            return after.select("u", F.col("v").alias("root"))
        edges = after.select("u", "v")
