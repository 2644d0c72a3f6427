"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Each
step is a minimum by node and a join on that node; the edges are written to
the shared folder between rounds. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import forget, materialise

#: Edges whose minima are broadcast (16 bytes each), and the share of all edges that makes a node a hub.
FEW, HUBS = 400_000, 256


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges: n rows (u, v) with u > v. Large: each neighbour above u points to u's minimum; small: each one below and u itself.

    Up to FEW edges the minima are broadcast. Beyond, a node of more than a HUBS-th of the edges would make one task of its join;
    such nodes, 2 * HUBS at most, are joined by broadcast, and the others by a shuffle.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    if n <= FEW:
        joined = both.join(F.broadcast(least), "u")
    else:
        hubs = F.broadcast(least.where(F.col("n") > n // HUBS).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
        dealt = both.join(hubs, F.col("u") == F.col("hub"), "left")
        joined = dealt.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).union(dealt.where("hub is null").select("u", "v").join(least, "u").select("u", "v", "m"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether each node of edges (u, v) points to one node, and that one to none."""
    uses = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    uses = F.broadcast(uses) if n <= FEW else uses
    again = edges.select("v").distinct().join(uses.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
    return edges.select("u").distinct().count() == n and again.count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), any order, repeats and loops allowed; root: the smallest node reachable.

    No edges give no rows; null ends are dropped. A node without an edge is
    its own component and isn't listed.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialise(now, "edges")
    while (n := now.count()) and not _stars(now, n):
        # A star has at most twice the edges that it is made from.
        following, at = materialise(_star(_star(now, True, n), False, 2 * n), "edges")
        forget(spark, path)
        now, path = following, at
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
