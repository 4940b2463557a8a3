"""Mixing sources to target weights by capped water-filling (operator 6).

Only DataFrame functions. Sizes are counted once and kept in files; sources are summed
there. A level is raised under all sources in proportion to their weights; a source
that reaches ``max_epochs`` times its size is clamped there and its excess goes to the
others by weight. With the sources in the order in which they clamp, one running sum
finds the level at which everything is shared out.

A source's wanted words are whole repetitions of all its documents and a rest. The rest
is taken from its documents in a seeded order up to a cut: documents before the cut once
more, the one at the cut for the words still missing. The cut is found from the sizes of
ranges of the order key, about as many as the square root of the rows, and then inside
one of them, so that no task orders a whole source. Sums over sources, whose number has
no bound, run within ranges of sources and over their totals (``running_sums``).

``sample`` gives whole documents only: the one at the cut once more if at least half of
it is missing.

Defined results: null text has size 0; null source is a source of its own, the last;
null doc_id takes a fixed place in the order; repeated rows that fall on the cut share
its words; with no words at all every target is 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import WORD, running_sums, table, through_files

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
#: One row for each source is broadcast up to this many sources; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def _order_key(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"__size": size, "__key": _order_key(seed)})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``; one row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"one": F.lit(1).cast("long"), "none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    by_source = through_files(by_source, "mix-sources")
    ranked = running_sums(by_source, [], ["none", "name"], {"place": "one"}, "mix-places")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.select("source", "source_size", "place", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    capped = through_files(capped.withColumn("ratio", F.col("cap") / F.col("weight")), "mix-caps")
    order = running_sums(capped, [], ["ratio", "place"], {"clamped_before": "cap", "weight_before": "weight"}, "mix-levels")
    whole = F.broadcast(capped.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight")))  # one row
    level = (F.col("all_size") - F.col("clamped_before")) / (F.col("all_weight") - F.col("weight_before"))
    leveled = through_files(order.join(whole).withColumn("level", level).withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level")), "mix-levels")
    final = F.broadcast(leveled.where(~F.col("clamped")).agg(F.max("level").alias("final")))  # one row
    return leveled.join(final).select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: sizes, target, whole repetitions, and the cut of the rest, from ``rows(source, size, key)``."""
    wanted = targets(rows, weights, max_epochs).withColumn("wanted", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0)
    wanted = through_files(wanted.withColumn("whole", whole).withColumn("rest", F.col("wanted") - F.col("whole") * F.col("source_size")), "mix-wanted")

    digits = max(3, -(-rows.count().bit_length() // 8))  # of the hexadecimal key: about the square root of the rows
    bins = rows.groupBy("source", F.substring("key", 1, digits).alias("bin")).agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("before", upto - F.col("held")).join(wanted.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    edge = bins.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("held"))).select("s", "bin", "before", "rest")

    near = rows.withColumn("b", F.substring("key", 1, digits)).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bin")))
    keys = near.groupBy("s", "key", "before", "rest").agg(F.sum("size").alias("held"), F.count("*").alias("copies"))
    upto = F.col("before") + F.sum("held").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = keys.withColumn("after", upto).where((F.col("after") - F.col("held") < F.col("rest")) & (F.col("rest") <= F.col("after")))
    cut = cut.select("s", F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("after") + F.col("held")) / F.col("copies")).alias("cut_words"))
    return wanted.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "cut_key", "cut_words")


def _with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(source, __size, __key) with __source_size, __target and __taken; names that rows may have don't clash."""
    sources = through_files(sources, "mix-plan")
    sources = sources.select(*(F.col(c).alias(f"__{c}") for c in sources.columns))
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    extra = F.when(F.col("__key") < F.col("__cut_key"), F.col("__size")).when(F.col("__key") == F.col("__cut_key"), F.least("__size", "__cut_words")).otherwise(0)
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("__s")))
    return joined.withColumn("__taken", (F.col("__whole") * F.col("__size") + extra).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``."""
    rows = through_files(_sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")), seed).drop("text"), "mix-sizes")
    sources = plan(rows.select("source", F.col("__size").alias("size"), F.col("__key").alias("key")), weights, max_epochs)
    return _with_plan(rows, sources).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of docs: a row with the whole text for each repetition; the document at the cut is rounded to whole ones."""
    sized = _sized(docs.withColumn("source", F.col("source").cast("string")), seed)
    rows = through_files(sized.select("source", F.col("__size").alias("size"), F.col("__key").alias("key")), "mix-sizes")
    mixed = _with_plan(sized, plan(rows, weights, max_epochs))
    repeats = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), repeats))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || doc_id::VARCHAR) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[(place - 1) % 3 + 1]::BIGINT AS weight, source_size * {MAX_EPOCHS} AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), t AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap::DOUBLE
         ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
  FROM l
), p AS (
  SELECT *, floor(target + 0.5)::BIGINT AS wanted,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t
), o AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.wanted - p.whole * p.source_size AS rest,
         coalesce((sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o
"""
