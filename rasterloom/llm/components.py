"""Connected components of a link table, by alternating large-star and small-star steps on Spark.

Every step replaces a node's links by links to its least neighbour; the fixed point is one star per component. Links and
labels stay in tables of the shared folder; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: u > v, distinct."""
    if large:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
        keep = F.col("x") > F.col("n")
    else:
        near, keep = edges.select(F.col("u").alias("n"), F.col("v").alias("x")), F.lit(True)
    # stored: a node of very many links can be split in the join
    least = stored(near.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m")), "cc-least")
    moved = near.join(maybe_broadcast(least), "n").where(keep).select(F.col("x").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (least node of its component) for every node that has a link; nodes are bigints.

    Self links and repeated links count for nothing; null ends are dropped; no links give an empty table.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, was = stored(edges, "cc-edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count_distinct("u").alias("k")).first()
        if now == was or not now["n"]:
            break
        if was is None and now["n"] == now["k"] and not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            break  # stars already
        was, edges = now, stored(_star(_star(edges, True), False), "cc-edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("root")))
