"""Connected components of an edge table, by alternating star contractions.

Every round replaces the edges of a node by edges to its least neighbour, first
on the greater side, then on the smaller, until nothing changes; what is left
are stars around the least node of each component.  Each round is a combinable
minimum per node and a join on it, both written to the shared folder: the minima
come to the join by an exchange of their own, so a hub can be split.  Nothing is
gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the greater node u to the smaller v."""
    least = stash(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (u, v: long)."""
    now = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stash(_small_star(_large_star(now).distinct()), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").distinct().toDF("node", "root"))
