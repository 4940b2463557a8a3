"""Connected components of an edge table by alternating large and small stars.

Each step takes minima by a partial aggregate and joins them back; the minima of nodes
with very many edges are broadcast (fewer than a thousand rows), so a star's centre
doesn't gather its edges in one task. Steps are cut by files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import spread_join, through_files


def _with_least(edges: DataFrame, label: str) -> DataFrame:
    """edges(u, v) with ``m``, the smallest of u and its neighbours."""
    least = through_files(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), label)
    return spread_join(edges, least, ["u"], "n")


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, label).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    found = _with_least(down, label)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(u long, v long)`` that isn't itself the smallest."""
    found = through_files(edges.select("u", "v").where("u <> v"), label)
    sign = None
    while True:
        wide = through_files(_large_star(found, label), label)
        found = through_files(_small_star(wide, label), label)
        seen = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == sign:
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
        sign = (seen["n"], seen["h"])
