"""Connected components by alternating large-star and small-star rounds over an edge table.

Both rounds are a minimum by key, found by a partially aggregated group-by, and a join that gives it
back to the edges; neighbour lists are never gathered, so a hub of any degree is split like any
skewed join. Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stash, stash


def _minimum(edges: DataFrame) -> DataFrame:
    return stash(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")


def large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are tied to the least of the node and all its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its lesser neighbours are tied to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge table (u, v): the least node that it reaches.

    Self-loops tell nothing and are dropped; an empty table gives no rows.
    """
    now = stash(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        for star in (large_star, small_star):
            made, least = star(now)
            following = stash(made, "edges")
            drop_stash(now)
            drop_stash(least)
            now = following
        if (then := _mark(now)) == mark:
            break
        mark = then
    # At the fixed point every edge is (node, root).
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
