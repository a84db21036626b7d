"""Connected components of an edge table by alternating star contractions, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's larger (or, all smaller) neighbours are linked to its least neighbour."""
    if large:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether the edges u > v are stars: every u has one edge, and none is the v of another."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 50) -> DataFrame:
    """(node, root): every node of an edge with the least node of its component.

    Each round is a constant number of joins, checkpointed to the shared folder; rounds grow with the logarithm
    of the largest component and end when all edges are stars. Nothing but one bit a round reaches the driver. Loops and
    repeated edges are harmless; null ends are left out; no edges give no rows.
    """
    pairs = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    pairs = cut(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if _settled(pairs):
            break
        pairs = cut(_stars(_stars(pairs, True), False))
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("root"))
