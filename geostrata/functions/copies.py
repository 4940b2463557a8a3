"""Rows that are equal but for an id: what the rest decides is found once for each distinct row and given back to all members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Members of one array, about.
BLOCK = 1024


def named(rows: DataFrame, by: list[str], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct *by with a number ``kind``; and ``kind, *ids`` of every row, neither shuffled nor sorted: the number is a hash of *by, unless two kinds share one."""
    number = F.xxhash64(*by).alias("kind")
    found = cut(rows.select(number, *by).distinct())
    if found.groupBy("kind").count().where("count > 1").isEmpty():
        return found, cut(rows.select(number, *ids))
    found = cut(found.select(*by).distinct().withColumn("kind", F.monotonically_increasing_id()))
    known = found.select("kind", *(F.col(c).alias(f"__{c}") for c in by))
    return found, cut(rows.join(known, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).select("kind", *ids))


def kinds(rows: DataFrame, by: list[str], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct *by with a number ``kind``; and ``kind, members``, arrays of about ``BLOCK`` structs of ids, so that no task gathers a large kind."""
    found, own = named(rows, by, ids)
    most = own.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64(*ids), F.lit(max(1, -(-most // BLOCK))))
    return found, cut(own.groupBy("kind", part.alias("__part")).agg(F.collect_list(F.struct(*ids)).alias("members")).select("kind", "members"))


def spread(pairs: DataFrame, one: DataFrame, two: DataFrame, first: str, second: str) -> DataFrame:
    """pairs with every member of kind ``first`` (struct a) and of kind ``second`` (struct b): blocks meet first, dealt evenly over the tasks, and are written out there."""
    met = pairs.join(one.select(F.col("kind").alias(first), F.col("members").alias("__a")), first).join(two.select(F.col("kind").alias(second), F.col("members").alias("__b")), second)
    met = met.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.withColumn("a", F.explode("__a")).drop("__a").withColumn("b", F.explode("__b")).drop("__b")
