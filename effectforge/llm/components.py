"""Connected components by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.llm.common import discard, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and none up, or edges up alone: then its component is done."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    per = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not per.filter("down > 1 or down = 1 and up = 1").limit(1).count()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours above (large) or below (small) go to the least.

    The least neighbour of a node is a map-side combined minimum, written out so
    that the join back can split a hub's rows over tasks.
    """
    if large:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
    else:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    joined = near.join(least, "u")
    if large:
        made = joined.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        made = joined.filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        )
    out = materialize(made.filter("hi <> lo").distinct(), "cc-edges")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (hi, lo), hi > lo; root is the least node.

    Rounds are logarithmic in the size of a component; each is written to the
    shared folder.  No edges give no rows.
    """
    now = materialize(edges.select("hi", "lo").distinct(), "cc-edges")
    while not _stars(now):
        wide = _star(now, large=True)
        discard(now)
        now = _star(wide, large=False)
        discard(wide)
    pairs = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    found = materialize(pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct()), "cc-roots")
    discard(now)
    return found
