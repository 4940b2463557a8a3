"""Exact percentiles of large groups, such as the cells of a raster, without one task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut

#: Groups up to this many values keep their exact aggregate; a sketch's ranks are off by a share of 1 / ACCURACY at most.
AT_ONCE, ACCURACY = 200_000, 10_000
#: Brackets are broadcast up to this many.
BROADCAST_BRACKETS = 200_000


def percentiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: list[float]) -> DataFrame:
    """*keys, p: the exact percentiles of value in each group, as an array, interpolated between ranks; nulls and NaN don't count, groups without values have no row.

    Small groups are aggregated at once. For a larger one a mergeable sketch gives a bracket around each rank that is asked for; what lies
    below is counted, and only the distinct values inside are put in order. df is read up to four times.
    """
    k = list(keys)
    if not k:
        return percentiles(df.withColumn("__all", F.lit(0)), ("__all",), value, shares).drop("__all")
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*k, F.col(value).cast("double").alias("__v"))
    sizes = cut(known.groupBy(*k).agg(F.count("*").alias("__n")))
    few = sizes.where(F.col("__n") <= AT_ONCE).select(*k)
    large = sizes.where(F.col("__n") > AT_ONCE)
    exact = lambda x: x.groupBy(*k).agg(F.percentile("__v", F.array(*map(F.lit, shares))).alias("p"))
    if large.isEmpty():
        return exact(known)
    some = F.broadcast if sizes.count() <= BROADCAST_BRACKETS else lambda x: x
    inner = known.join(some(large), k)
    edge = 4.0 / ACCURACY
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in (-edge, edge)]
    rough = inner.groupBy(*k).agg(F.first("__n").alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, asked)), ACCURACY).alias("__at"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    open_ = lambda i: F.col("__at")[i]
    brackets = F.posexplode(F.array(*(F.struct(F.lit(float(s)).alias("share"), (F.when(F.lit(s) <= edge, F.col("__min")).otherwise(open_(2 * i))).alias("low"), (F.when(F.lit(s) >= 1 - edge, F.col("__max")).otherwise(open_(2 * i + 1))).alias("high")) for i, s in enumerate(shares))))
    ranks = cut(rough.select(*k, "__n", brackets.alias("__i", "b")).select(*k, "__i", (F.col("b.share") * (F.col("__n") - 1)).alias("__rank"), "b.low", "b.high"))
    met = inner.drop("__n").join(some(ranks), k)
    below = met.groupBy(*k, "__i").agg(F.count_if(F.col("__v") < F.col("low")).alias("__below"))
    values = met.where(F.col("__v").between(F.col("low"), F.col("high"))).groupBy(*k, "__i", "__rank", "__v").agg(F.count("*").alias("__c"))
    placed = values.join(below, [*k, "__i"])
    upto = F.sum("__c").over(Window.partitionBy(*k, "__i").orderBy("__v")) + F.col("__below")
    placed = placed.withColumn("__upto", upto)
    first, last = F.floor("__rank"), F.ceil("__rank")
    at = lambda r: F.min(F.when(F.col("__upto") > r, F.col("__v")))
    found = placed.groupBy(*k, "__i").agg(at(first).alias("a"), at(last).alias("b"), F.first("__rank").alias("r"), F.min(F.col("__upto") - F.col("__c")).alias("from"), F.max("__upto").alias("to"))
    held = (F.col("from") <= F.floor("r")) & (F.col("to") > F.ceil("r"))
    mid = F.when(held, F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - F.floor("r"))).otherwise(F.raise_error(F.lit("a sketch missed a rank")).cast("double"))
    wide = found.select(*k, "__i", mid.alias("v")).groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "v"))), lambda x: x["v"]).alias("p"))
    return exact(known.join(some(few), k, "left_semi")).unionByName(wide)
