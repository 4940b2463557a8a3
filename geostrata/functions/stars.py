"""Connected components of an edge table by alternating large and small stars.

Up to ``ONE_TASK`` edges between numbers are joined in one task. Otherwise the number of rounds grows with the logarithm of the longest path. Each round is cut by
a checkpoint; minima are partial aggregates that are joined back. The training-data part
has its own over files, as neither part imports the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m; the minima of nodes with more than a thousandth of the edges, fewer than a thousand, are broadcast, so a star's centre doesn't gather in a task."""
    least = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
    large = F.col("n") * 1000 > (least.agg(F.sum("n")).first()[0] or 0)
    heavy, light = least.where(large).drop("n"), least.where(~large).drop("n")
    return edges.join(F.broadcast(heavy), "u").unionByName(edges.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(light, "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    found = _with_least(down)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one centre that points nowhere: nothing would change any more."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where(F.col("out") + F.col("in") > F.greatest(F.lit(1), F.col("in"))).isEmpty()


#: Edges that one task joins at once; more are joined in rounds.
ONE_TASK = 50_000


def _at_once(edges: DataFrame) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        above: dict[int, int] = {}

        def root(n: int) -> int:
            while above.get(n, n) != n:
                above[n] = n = above.get(above[n], above[n])
            return n

        for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            low, high = sorted((root(a), root(b)))
            above[low], above[high] = above.get(low, low), low
            above.setdefault(a, low), above.setdefault(b, low)
        found = [(n, root(n)) for n in above]
        return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["node", "component"], dtype="int64")

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(u, v)`` (numbers, or structs of a site and a number) that isn't itself the smallest."""
    found = cut(edges.select("u", "v").where("u <> v"))
    if all(kind == "bigint" for _, kind in found.dtypes) and found.count() <= ONE_TASK:
        return _at_once(found)
    while True:
        found = cut(_small_star(cut(_large_star(found))))
        if _stars(found):
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
