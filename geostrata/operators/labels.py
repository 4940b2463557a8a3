"""Labels of sites: class names, merging, canonical classes, validity, bounds, coverage and tiers of agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..model import GRID, Grid
from ..views import OBJECTS, detections, table, truths
from .matching import outlines, rasterize

#: Modality tokens that end a label file's class name (fixed values).
MODALITIES = ("la", "or", "ge", "sp")


def split_name(stem: Column) -> tuple[Column, Column]:
    """Name and modality of a file stem ``<class>_<modality>_...``; without a modality the whole stem and an empty string."""
    tokens = F.split(F.lower(stem), "_")
    places = F.filter(F.transform(F.array(*map(F.lit, MODALITIES)), lambda m: F.array_position(tokens, m)), lambda p: p > 1)
    at = F.array_min(places).cast("int")
    name = F.when(at.isNull(), F.lower(stem)).otherwise(F.array_join(F.slice(tokens, 1, F.greatest(at - 1, F.lit(0))), "_"))
    return name, F.when(at.isNull(), "").otherwise(F.element_at(tokens, at))


def class_of(stem: Column, aliases: list[tuple[str, str]]) -> Column:
    """The class of an exact alias, else of the first alias contained, else null."""
    name, _ = split_name(stem)
    exact = F.element_at(F.create_map(*(F.lit(x) for pair in aliases for x in pair)), name)
    return F.coalesce(exact, names.first_of(name, aliases))


def merge_labels(files: DataFrame, aliases: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """``files(site, stem, n)``: counts by site and class of recognised files, and the stems that no alias knows."""
    tagged = files.withColumn("cls", class_of(F.col("stem"), aliases))
    return tagged.where("cls is not null").groupBy("site", "cls").agg(F.sum("n").alias("n")), tagged.where("cls is null").select("site", "stem")


def detect_class_key(properties: DataFrame, known: list[str]) -> DataFrame:
    """``properties(k, v)``: the key whose values are most often known classes; ties go to the first key by name."""
    hits = properties.where(names.norm(F.col("v")).isin(known)).groupBy("k").agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), "k").limit(1)


def class_validity(folders: DataFrame, classes: list[str], needs: dict[str, list[str]]) -> DataFrame:
    """``folders(site, code)``: site, cls, observed; a class is observed if one of the folders it needs is there, or it needs none."""
    spark = folders.sparkSession
    want = spark.createDataFrame([(c, n) for c in classes for n in needs.get(c, [None])], "cls string, need string")
    sites = folders.select("site").distinct()
    found = folders.distinct().withColumn("hit", F.lit(True))
    both = sites.join(F.broadcast(want)).join(found.withColumnRenamed("code", "need"), ["site", "need"], "left")
    return both.groupBy("site", "cls").agg(F.bool_or(F.coalesce("hit", F.col("need").isNull())).alias("observed"))


def bounds_loss(objects: DataFrame, grid: Grid = GRID, flag: float = 0.02) -> DataFrame:
    """By class: objects, those whose centre lies outside the grid (closed), their share, and whether it is above flag."""
    out = ~grid.contains(F.col("cx"), F.col("cy"))
    found = objects.groupBy("cls").agg(F.count("*").alias("n"), F.count_if(out).alias("lost"))
    return found.withColumn("share", F.col("lost") / F.col("n")).withColumn("flagged", F.col("share") > flag)


def object_coverage(objects: DataFrame, measured: DataFrame, grid: Grid = GRID) -> DataFrame:
    """By class: pixels of the objects and the share of them that ``measured(row, col)`` holds."""
    pixels = rasterize(objects, grid).join(measured.select("row", "col").withColumn("m", F.lit(1)), ["row", "col"], "left")
    return pixels.groupBy("cls").agg(F.count("*").alias("n"), F.avg(F.coalesce("m", F.lit(0))).alias("share"))


def weighted_score(counts: DataFrame, weights: dict[int, float], eps: float = 1e-9) -> DataFrame:
    """``counts(cls, tp, fp, fn)``: weighted mean of F1 with false positives counting half, over classes in the ground truth."""
    w = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("cls"))
    p, r = F.col("tp") / (F.col("tp") + 0.5 * F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    there = counts.where(F.col("tp") + F.col("fn") > 0)
    return there.agg((F.sum(w * f1) / F.sum(w)).alias("score"))


ALIASES = [("economy_anodized", "coated"), ("steel", "metal"), ("brass", "metal"), ("copper", "metal"), ("standard", "plain")]


def _stems(spark, sf_dir):
    key = F.col("p_partkey")
    stem = F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.when(key % 3 == 0, "_La_v1").when(key % 3 == 1, "_or").otherwise(""))
    return table(spark, sf_dir, "part").select((key % 50).alias("site"), stem.alias("stem"), F.col("p_size").cast("long").alias("n"))


def q_split_name(spark, sf_dir):
    name, modality = split_name(F.col("stem"))
    return _stems(spark, sf_dir).select("site", "stem", name.alias("name"), modality.alias("modality"), class_of(F.col("stem"), ALIASES).alias("cls"))


def q_merge(spark, sf_dir):
    return merge_labels(_stems(spark, sf_dir), ALIASES)[0]


def q_class_key(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select(F.explode(F.create_map(F.lit("kind"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("k", "v"))
    return detect_class_key(cust, ["building", "machinery", "7"])


def q_validity(spark, sf_dir):
    folders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.format_string("%02d_", (F.col("o_custkey") + F.col("o_orderkey") % 2) % 9).alias("code"))
    return class_validity(folders, ["mound", "find", "house"], {"find": ["07_"], "house": ["03_", "04_"]})


def q_bounds(spark, sf_dir):
    far = truths(spark, sf_dir).withColumn("cx", F.col("cx") * 1.2)
    return bounds_loss(far).select("cls", "n", "lost", F.round("share", 6).alias("share"), "flagged")


def q_coverage(spark, sf_dir):
    measured = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.floor((F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_suppkey") * 3) % 1000 / F.lit(10.0)).cast("int").alias("row"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("col")).distinct()
    return object_coverage(outlines(truths(spark, sf_dir)), measured).select("cls", "n", F.round("share", 6).alias("share"))


def q_weighted(spark, sf_dir):
    counts = detections(spark, sf_dir).groupBy("cls").agg(F.count_if(F.col("score") > 0.5).alias("tp"), F.count_if(F.col("score") <= 0.2).alias("fp"), F.count_if(F.col("half") > 2).alias("fn"))
    return weighted_score(counts, {0: 30.0, 1: 20.0, 2: 15.0, 3: 10.0}).select(F.round("score", 6).alias("score"))


QUERIES = {"split_label_names": q_split_name, "merge_labels": q_merge, "detect_class_key": q_class_key, "class_validity": q_validity, "label_bounds_loss": q_bounds, "object_coverage": q_coverage, "weighted_score": q_weighted}

_STEMS = """stems AS (SELECT p_partkey % 50 AS site, replace(p_type, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_La_v1' WHEN 1 THEN '_or' ELSE '' END AS stem, p_size::BIGINT AS n FROM part),
named AS (SELECT *, CASE WHEN regexp_matches(lower(stem), '.+_(la|or)(_|$)') THEN regexp_extract(lower(stem), '^(.+?)_(la|or)(_.*)?$', 1) ELSE lower(stem) END AS name, regexp_extract(lower(stem), '_(la|or)(_|$)', 1) AS modality FROM stems),
tagged AS (SELECT *, CASE WHEN name = 'economy_anodized' THEN 'coated' WHEN name IN ('steel', 'brass', 'copper') THEN 'metal' WHEN name = 'standard' THEN 'plain' WHEN contains(name, 'economy_anodized') THEN 'coated'
  WHEN contains(name, 'steel') OR contains(name, 'brass') OR contains(name, 'copper') THEN 'metal' WHEN contains(name, 'standard') THEN 'plain' END AS cls FROM named)"""
ORACLES = {
    "split_label_names": f"WITH {_STEMS} SELECT site, stem, name, modality, cls FROM tagged",
    "merge_labels": f"WITH {_STEMS} SELECT site, cls, sum(n)::BIGINT AS n FROM tagged WHERE cls IS NOT NULL GROUP BY ALL",
    "detect_class_key": """WITH p AS (SELECT 'kind' AS k, c_mktsegment AS v FROM customer UNION ALL SELECT 'name', c_name FROM customer UNION ALL SELECT 'nation', c_nationkey::VARCHAR FROM customer)
      SELECT k, count(*) AS hits FROM p WHERE lower(trim(v)) IN ('building', 'machinery', '7') GROUP BY k ORDER BY hits DESC, k LIMIT 1""",
    "class_validity": """WITH f AS (SELECT DISTINCT o_custkey AS site, (o_custkey + o_orderkey % 2) % 9 AS code FROM orders), s AS (SELECT DISTINCT site FROM f)
      SELECT site, 'mound' AS cls, true AS observed FROM s UNION ALL SELECT site, 'find', EXISTS (SELECT 1 FROM f WHERE f.site = s.site AND code = 7) FROM s
      UNION ALL SELECT site, 'house', EXISTS (SELECT 1 FROM f WHERE f.site = s.site AND code IN (3, 4)) FROM s""",
    "label_bounds_loss": f"""WITH {OBJECTS}, c AS (SELECT cls, count(*) AS n, count(*) FILTER (NOT (cx * 1.2::DOUBLE BETWEEN 0 AND 105 AND cy BETWEEN 0 AND 100)) AS lost FROM gt GROUP BY cls)
      SELECT cls, n, lost, round(lost / n, 6) AS share, lost / n > 0.02 AS flagged FROM c""",
    "object_coverage": f"""WITH {OBJECTS}, m AS (SELECT DISTINCT floor(((l_orderkey * 37 + l_partkey * 11 + l_suppkey * 3) % 1000) / 10::DOUBLE)::INT AS row, floor(l_extendedprice / 1000)::INT AS col FROM lineitem WHERE l_quantity > 40),
      g AS (SELECT r.range::INT AS row, c.range::INT AS col FROM range(100) r, range(105) c),
      p AS (SELECT DISTINCT cls, row, col FROM g JOIN gt ON col + 0.5::DOUBLE >= cx - half AND col + 0.5::DOUBLE < cx + half AND row + 0.5::DOUBLE >= cy - half AND row + 0.5::DOUBLE < cy + half)
      SELECT cls, count(*) AS n, round(avg((m.row IS NOT NULL)::INT), 6) AS share FROM p LEFT JOIN m ON m.row = p.row AND m.col = p.col GROUP BY cls""",
    "weighted_score": f"""WITH {OBJECTS}, c AS (SELECT cls, count(*) FILTER (score > 0.5) AS tp, count(*) FILTER (score <= 0.2) AS fp, count(*) FILTER (half > 2) AS fn FROM det GROUP BY cls),
      f AS (SELECT cls, tp, fn, tp / (tp + 0.5 * fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r, ([30, 20, 15, 10])[cls + 1] AS w FROM c WHERE tp + fn > 0)
      SELECT round(sum(w * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(w), 6) AS score FROM f""",
}
