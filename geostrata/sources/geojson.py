"""GeoJSON collections: scan to one row for each part, and a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import norm_crs
from ..operators.geometry import oriented

_POINT = "struct<x:double,y:double>"


def _ring(coords: Column) -> Column:
    """Vertices without height and without the closing one."""
    pts = F.transform(coords, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = (F.size(pts) > 1) & (F.element_at(pts, 1) == F.element_at(pts, -1))
    return F.when(closed, F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0)))).otherwise(pts)


def read(spark, path: str, class_key: str = "class") -> DataFrame:
    """path, crs, feat_id, part_id, cls, score, geom_type, rings of every part of every feature with a geometry.

    A point is one ring of one vertex. Features without geometry are left out; one with a geometry but no class raises.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc"))
    declared = norm_crs(F.try_variant_get("doc", "$.crs.properties.name", "string"))
    feats = text.select("path", declared.alias("crs"), F.posexplode(F.try_variant_get("doc", "$.features", "array<variant>")).alias("feat_id", "f"))
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    named = feats.withColumn("geom_type", kind).where("geom_type is not null")
    cls = F.try_variant_get("f", f"$.properties.{class_key}", "string")
    named = named.withColumn("cls", F.coalesce(cls, F.raise_error(F.lit(f"a feature has no {class_key}")).cast("string")))
    at = "$.geometry.coordinates"
    polygon = F.try_variant_get("f", at, "array<array<array<double>>>")
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(F.try_variant_get("f", at, "array<double>")))))
        .when(kind == "MultiPoint", F.transform(F.try_variant_get("f", at, "array<array<double>>"), lambda p: F.array(F.array(p))))
        .when(kind == "Polygon", F.array(polygon))
        .when(kind == "MultiPolygon", F.try_variant_get("f", at, "array<array<array<array<double>>>>"))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported geometry: "), kind)).cast("array<array<array<array<double>>>>"))
    )
    score = F.coalesce(F.try_variant_get("f", "$.properties.score", "double"), F.lit(1.0))
    rows = named.select("path", "crs", "feat_id", "cls", score.alias("score"), F.replace("geom_type", F.lit("Multi"), F.lit("")).alias("geom_type"), F.posexplode(parts).alias("part_id", "coords"))
    return rows.select("path", "crs", "feat_id", "part_id", "cls", "score", "geom_type", F.transform("coords", _ring).alias("rings"))


def _head(crs: str) -> str:
    return f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"{crs}"}}}},"features":['


def _line(class_key: str, extra: tuple[str, ...] = ()) -> Column:
    """A feature as text."""
    point = F.to_json(F.array(F.col("rings")[0][0]["x"], F.col("rings")[0][0]["y"]))
    rings = F.to_json(F.transform(oriented(F.col("rings")), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    props = F.to_json(F.struct(F.col("cls").alias(class_key), F.col("score"), *extra))
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), F.when(F.col("geom_type") == "Point", point).otherwise(rings), F.lit("}}"))


def write(features: DataFrame, path: str, crs: str = "EPSG:3857", class_key: str = "class", extra: tuple[str, ...] = (), files: int = 1) -> None:
    """Collections in ``files`` text files from features(feat_id, cls, score, geom_type, rings); empty input gives an empty collection.

    A file holds one line for each feature, so no task joins them into one value, and is written by one task; features
    are dealt to files by a hash of feat_id, which may repeat or be null (first). ``extra`` names further columns that become properties.
    """
    line = _line(class_key, extra)
    spark = features.sparkSession
    file = F.pmod(F.xxhash64("feat_id"), F.lit(files)).cast("int").alias("file")
    body = features.select(file, F.lit(1).alias("part"), F.col("feat_id").cast("long").alias("k"), line.alias("value"))
    head = _head(crs)
    ends = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(v).alias("value")) for p, v in ((0, head), (2, "]}"))))).alias("e"))
    ends = ends.select("file", "e.part", F.lit(0).cast("long").alias("k"), "e.value")
    lines = ends.unionByName(body).repartitionById(files, F.col("file")).sortWithinPartitions("part", "k", "value")
    # a file is a partition, so a line's number in it says whether a feature comes before
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    comma = (number > 1) & (F.col("part") == 1)  # in this order, as a number is given where it is asked for
    lines.select(F.when(comma, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def write_by(features: DataFrame, groups: DataFrame, key: str, path: str, crs: str = "EPSG:3857", class_key: str = "class") -> None:
    """A collection for each of ``groups(key)`` in a folder ``key=...`` of its own, an empty one without features(key, feat_id, cls, score, geom_type, rings).

    A group is one sorted run of lines in a task, never a value; features of a key that groups lack aren't written.
    """
    body = features.join(groups.select(key).distinct(), key, "left_semi").select(key, F.lit(1).alias("part"), F.col("feat_id").cast("long").alias("k"), _line(class_key).alias("value"))
    ends = F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("k"), F.lit(v).alias("value")) for p, v in ((0, _head(crs)), (2, "]}")))))
    lines = body.unionByName(groups.select(key).distinct().select(key, ends))
    before = F.lag("part").over(Window.partitionBy(key).orderBy("part", "k", "value"))
    text = lines.withColumn("value", F.when((F.col("part") == 1) & (before == 1), F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    # the window leaves a group in one partition and in order, which the writer keeps
    text.sortWithinPartitions(key, "part", "k", F.ltrim(F.lit(","), "value")).select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def merge(spark, paths: list[str], out: str, class_key: str = "class") -> None:
    """One collection of the features of several files, numbered anew in the order of paths, with the system that the first one declares."""
    joined, crs = None, None
    for k, path in enumerate(paths):
        rows = read(spark, path, class_key).withColumn("source", F.lit(k))
        found = rows.select("crs").limit(1).collect()
        crs = crs or (found[0]["crs"] if found else None)
        joined = rows if joined is None else joined.unionByName(rows)
    # file, feature and part packed into one number: up to 2 ** 31 features of 2 ** 20 parts in a file
    number = F.col("source").cast("long") * (1 << 51) + F.col("feat_id").cast("long") * (1 << 20) + F.col("part_id")
    write(joined.withColumn("feat_id", number), out, (crs or "epsg:3857").upper(), class_key)


def write_errors(found: DataFrame, preds: DataFrame, gts: DataFrame, path: str, crs: str = "EPSG:3857", class_key: str = "class") -> None:
    """A collection of the unmatched objects of ``matching.errors`` with their kind and error."""
    columns = ["id", F.col("cls").cast("string").alias("cls"), "geom_type", "rings"]
    fp = found.where("kind = 'FP'").join(preds.select(*columns, "score"), "id")
    fn = found.where("kind = 'FN'").join(gts.select(*columns, F.lit(1.0).alias("score")), "id")
    rows = fp.unionByName(fn).withColumn("feat_id", F.col("id") * 2 + (F.col("kind") == "FN").cast("int"))
    write(rows, path, crs, class_key, ("kind", "error"))
