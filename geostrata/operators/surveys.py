"""Surveys of folders, label files and rebuilt layers: listings, layers to take, issues, limits, boxes, guards, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projection
from ..model import GRID, Frame
from ..views import INSIDE, POINTS, full_grid, points, table
from .cells import with_cells
from .rasters import stretch

#: Endings of temporary files, folder codes of a site, words that name a folder's content.
TEMPORARY = r"(?i)(\.~|~$|\.tmp$|\.part$|\.crdownload$|\.sync$)"
FOLDER_CODE = "^0[1-7]"
#: Limits of a submitted file.
MAX_BYTES, MAX_FEATURES, MAX_VERTICES = 100 << 20, 20_000, 3_000
FEET = 0.3048


def survey(files: DataFrame) -> DataFrame:
    """One row for each site of ``files(site, folder, name, bytes)``, folder being empty for files of the site itself.

    las, rasters and their bytes count by name in all folders; files, bytes and empty count what stands in coded folders
    and isn't temporary; codes lists those folders' codes; ok if there are both points and rasters.
    """
    low = F.lower("name")
    temporary, las, raster = F.col("name").rlike(TEMPORARY), low.rlike(r"\.la[sz]$"), low.rlike(r"\.tiff?$")
    kept = ~temporary & F.col("folder").rlike(FOLDER_CODE)
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    found = files.groupBy("site").agg(
        F.count_if(las).alias("las"), F.count_if(raster).alias("rasters"), size(las).alias("las_bytes"), size(raster).alias("raster_bytes"),
        F.count_if(temporary).alias("temporary"), F.count_if(kept).alias("files"), size(kept).alias("bytes"), F.count_if(kept & (F.col("bytes") == 0)).alias("empty"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("folder").rlike(FOLDER_CODE), F.left("folder", F.lit(2))))), ",").alias("codes"),
    )
    return found.withColumn("ok", (F.col("las") > 0) & (F.col("rasters") > 0))


def survey_totals(surveys: DataFrame) -> DataFrame:
    """One row over all sites."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return surveys.agg(F.count("*").alias("sites"), F.count_if("ok").alias("ok"), *map(total, ("las", "rasters", "las_bytes", "raster_bytes", "temporary", "empty")))


def discover_layers(files: DataFrame) -> DataFrame:
    """``files(folder, name)`` with the layer that a map takes from each; the folder's first rule decides, and other kinds of files drop out."""
    folder, stem = F.lower("folder"), F.regexp_replace("name", r"\.[^.]*$", "")
    last = F.element_at(F.split(stem, "_"), -1)
    kind = (
        F.when(folder.contains("la_") | (folder.contains("lidar") & ~folder.contains("карты")), "points")
        .when(folder.contains("li_") | folder.contains("lidar"), "maps")
        .when(folder.rlike("ae_|aerial|аэро"), "photos")
        .when(folder.rlike("разметка|annotation"), "labels")
    )
    tif = F.col("name").rlike(r"\.tiff?$")
    layer = (
        F.when((kind == "points") & F.col("name").rlike(r"\.la[sz]$"), "lidar_points")
        .when((kind == "maps") & tif, F.concat(F.lit("lidar_"), last))
        .when((kind == "photos") & tif, "aerial")
        .when((kind == "labels") & F.col("name").endswith(".geojson"), F.concat(F.lit("annotation_"), F.when(stem.contains("_"), last).otherwise("annotation")))
    )
    return files.withColumn("layer", layer).where("layer is not null")


#: Prefixes of layers that carry a parameter and its default (fixed values).
RELIEF = {"hillshade_az": 45.0, "slrm_sigma": 2.0, "curvature_sigma": 2.0, "tpi_radius": 5.0, "tri_radius": 3.0}


def relief_parameters(layers: DataFrame) -> DataFrame:
    """site, parameter, values: what the names in ``layers(site, layer)`` tell of the relief's parameters, in ascending order, or the default."""
    parts = layers.select("site", F.regexp_extract("layer", r"^(.*)_([0-9.]+)$", 1).alias("parameter"), F.regexp_extract("layer", r"^(.*)_([0-9.]+)$", 2).try_cast("double").alias("v"))
    known = parts.groupBy("site", "parameter").agg(F.array_sort(F.collect_set("v")).alias("found"))
    want = layers.select("site").distinct().select("site", F.explode(F.create_map(*(F.lit(x) for pair in RELIEF.items() for x in pair))).alias("parameter", "fallback"))
    return want.join(known, ["site", "parameter"], "left").select("site", "parameter", F.coalesce(F.when(F.size("found") > 0, F.col("found")), F.array("fallback")).alias("values"))


def site_issues(labels: DataFrame, sources: DataFrame, known: list[str], region: tuple[float, float, float, float]) -> DataFrame:
    """site, level, issue, n of sites whose merged ``labels(site, cls, file_cls, x, y)`` don't agree with ``sources(site, cls, n)``.

    x is null without a geometry; file_cls is the class of the file that a label came from, null if unknown; a column file
    of labels says that there was one. A label without geometry counts as that alone, one without class likewise: neither
    is in the totals, the classes or the box. Sources without class count in the total; each row of them is a file. A site
    without labels has that one error. n counts labels, classes or files, or is the surplus of labels; for boxes it is the
    number of labels.
    """
    empty = F.col("cls").isNull() | (F.col("cls") == "")
    there, good = F.col("x").isNotNull(), F.col("x").isNotNull() & ~empty
    strange = good & F.col("file").isNotNull() & F.col("file_cls").isNull() if "file" in labels.columns else F.lit(False)
    labels = labels.withColumns({"bare": ~there, "unnamed": there & empty, "good": good, "strange": strange, "foreign": good & (F.col("file_cls") != F.col("cls"))})
    labels = labels.withColumns({"cls": F.when(F.col("good"), F.col("cls")), **{c: F.when(F.col("good"), F.col(c)) for c in ("x", "y")}})
    tally = labels.groupBy("site", "cls").agg(
        F.count("*").alias("rows"), *(F.count_if(c).alias(n) for c, n in (("good", "n"), ("foreign", "foreign"), ("bare", "bare"), ("unnamed", "unnamed"), ("strange", "strange"))),
        F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"),
    )
    given = sources.groupBy("site", "cls").agg(F.sum("n").alias("given"), F.count_if(F.col("cls").isNull()).alias("files"))
    both = tally.join(given, (tally.site.eqNullSafe(given.site)) & (tally.cls.eqNullSafe(given.cls)), "full_outer").select(
        F.coalesce(tally.site, given.site).alias("site"), F.coalesce(tally.cls, given.cls).alias("cls"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "n", "given", "foreign", "bare", "unnamed", "strange", "files")), "west", "south", "east", "north"
    )
    named, delta = F.col("cls").isNotNull(), F.col("n") - F.col("given")
    site = both.groupBy("site").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum(delta).alias("delta"), F.count_if(named & (delta != 0)).alias("classes"), F.sum("foreign").alias("foreign"), F.sum("bare").alias("bare"),
        F.coalesce(F.sum(F.when(named & ~F.col("cls").isin(known), F.col("n"))), F.lit(0)).alias("unknown"), *(F.sum(c).alias(c) for c in ("unnamed", "strange", "files")),
        F.sum("given").alias("given"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
    )
    degrees = (F.col("east") <= 180) & (F.col("north") <= 90)
    outside = (F.col("west") < region[0]) | (F.col("south") < region[1]) | (F.col("east") > region[2]) | (F.col("north") > region[3])
    rules = [
        ("error", "count differs", F.col("delta") != 0, "delta"), ("error", "classes differ", F.col("classes") > 0, "classes"), ("error", "class of another file", F.col("foreign") > 0, "foreign"),
        ("error", "unknown class", F.col("unknown") > 0, "unknown"), ("error", "no class", F.col("unnamed") > 0, "unnamed"), ("error", "coordinates in degrees", degrees, "n"),
        ("warning", "outside the region", ~degrees & outside, "n"), ("warning", "no geometry", F.col("bare") > 0, "bare"),
        ("warning", "unrecognised file", F.col("strange") > 0, "strange"), ("warning", "source file without class", F.col("files") > 0, "files"),
    ]
    issue = lambda level, text, n: F.struct(F.lit(level).alias("level"), F.lit(text).alias("issue"), F.col(n).cast("long").alias("n"))
    several = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), issue(level, text, n)) for level, text, c, n in rules)))
    return site.select("site", F.inline(F.when(F.col("rows") == 0, F.array(issue("error", "no labels", "given"))).otherwise(several)))


def class_audit(masks: DataFrame, least: float = 1e-5) -> DataFrame:
    """site, cls, seg_px, hm_px, n, scarce of ``masks(site, cls, seg, hm)``: cells of a class and of its bumps' cores; site is null over all sites."""
    found = masks.rollup("cls", "site").agg(F.count_if(F.col("seg") > 0).alias("seg_px"), F.count_if(F.col("hm") >= 0.5).alias("hm_px"), F.count("*").alias("n"))
    return found.where("cls is not null").withColumn("scarce", F.col("seg_px") / F.col("n") < least)


def numeric_pairs(json: Column) -> Column:
    """(x, y) of every array in a JSON text that begins with two numbers, however deep; texts within it are passed over. Null and no pair: an empty array."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', '""')
    at = lambda k: F.regexp_extract_all(bare, F.lit(rf"\[\s*({number})\s*,\s*({number})"), k)
    pairs = F.arrays_zip(F.transform(at(1), lambda v: v.cast("double")).alias("x"), F.transform(at(2), lambda v: v.cast("double")).alias("y"))
    return F.coalesce(pairs, F.lit(None).cast("array<struct<x:double,y:double>>"), F.array().cast("array<struct<x:double,y:double>>"))


def bounds(places: DataFrame, code: int, key: str = "key") -> DataFrame:
    """key, west, south, east, north in degrees of all pairs in ``places(key, json)``, given in the system ``code``."""
    lon, lat = projection.to_lon_lat(code, F.col("p")["x"], F.col("p")["y"])
    pairs = places.select(key, F.explode(numeric_pairs(F.col("json"))).alias("p")).select(key, lon.alias("lon"), lat.alias("lat"))
    return pairs.groupBy(key).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def submission_limits(files: DataFrame, features: DataFrame, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES, max_vertices: int = MAX_VERTICES, crs: str = "EPSG:3857") -> DataFrame:
    """file, problem, n: what ``files(file, bytes, crs)`` and their ``features(file, json)`` have beyond the limits; a file that declares no system passes as one in ``crs``."""
    sizes = features.select("file", F.size(numeric_pairs(F.col("json"))).alias("v")).groupBy("file").agg(F.count("*").alias("features"), F.count_if(F.col("v") > max_vertices).alias("long"))
    every = files.join(sizes, "file", "left")
    rules = [
        ("file too large", F.col("bytes") > max_bytes, "bytes"), ("too many features", F.col("features") > max_features, "features"), ("polygons with too many vertices", F.col("long") > 0, "long"),
        ("another coordinate system", projection_name(F.col("crs")) != projection_name(F.lit(crs)), "features"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(text).alias("problem"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n"))) for text, c, n in rules)))
    return every.select("file", F.inline(found))


def projection_name(crs: Column) -> Column:
    """The EPSG number that ends a system's name, as text; null without one."""
    return F.nullif(F.regexp_extract(crs, r"(\d+)\s*$", 1), F.lit(""))


def grids_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two structs(crs, pixel_size, x_min, y_min, width, height) are one frame."""
    close = [F.abs(a[c] - b[c]) <= tolerance for c in ("pixel_size", "x_min", "y_min")]
    same = [a[c].eqNullSafe(b[c]) for c in ("crs", "width", "height")]
    out = F.lit(True)
    for c in (*same, *close):
        out = out & F.coalesce(c, F.lit(False))
    return out


def to_metres(pts: DataFrame, declared: str = "meters", span: float = 100.0) -> DataFrame:
    """``pts(site, z)`` with z in metres and z_unit: a site whose heights span more than ``span`` is in feet, whatever was declared."""
    unit = F.when(F.max("z") - F.min("z") > span, "feet").otherwise(declared).alias("z_unit")
    units = pts.groupBy("site").agg(unit).withColumnRenamed("site", "__site")
    both = pts.join(units, pts.site.eqNullSafe(units["__site"])).drop("__site")
    return both.withColumn("z", F.when(F.col("z_unit") == "feet", F.col("z") * FEET).otherwise(F.col("z")))


def attribute_raster(pts: DataFrame, value: str, grid: Frame = GRID) -> DataFrame:
    """row (0 is north here), col, value, byte: the largest value of each cell's points, 0 without any or below 0, stretched to bytes."""
    top = with_cells(pts, grid).where("valid").groupBy("row", "col").agg(F.max(value).alias("value"))
    every = full_grid(pts.sparkSession, grid).join(top, ["row", "col"], "left").withColumn("value", F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0))))
    return stretch(every, "value").withColumn("row", F.lit(grid.height - 1) - F.col("row"))


def ingest_verdicts(sites: DataFrame, covered: DataFrame, max_pixels: int = 12_000_000, least: float = 0.05) -> DataFrame:
    """site, pixels, coverage, build, reason of ``sites(site, width, height, built)``, given the cells ``covered(site, row, col)`` that sources reach; the first reason counts."""
    found = covered.distinct().groupBy("site").agg(F.count("*").alias("reached"))
    joined = sites.withColumn("pixels", F.col("width").cast("long") * F.col("height")).join(found, "site", "left")
    share = F.when(F.col("pixels") > 0, F.coalesce("reached", F.lit(0)) / F.col("pixels")).otherwise(0.0)
    reason = F.when(F.col("pixels") > max_pixels, "too large").when(F.col("built"), "already built").when(F.col("coverage") < least, "too little coverage")
    return joined.withColumn("coverage", share).withColumn("reason", reason).select("site", "pixels", "coverage", F.col("reason").isNull().alias("build"), "reason")


def compare_layers(before: DataFrame, after: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """By layer of two ``cells(layer, row, col, value)``: cells with a value before and after, lost, gained and changed ones, the largest change, and whether the masks are equal."""
    a, b = before.where("value is not null").withColumnRenamed("value", "a"), after.where("value is not null").withColumnRenamed("value", "b")
    gap = F.abs(F.col("a") - F.col("b"))
    found = a.join(b, ["layer", "row", "col"], "full_outer").groupBy("layer").agg(
        F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("gained"),
        F.count_if(gap > tolerance).alias("changed"), F.coalesce(F.max(gap), F.lit(0.0)).alias("largest"),
    )
    return found.withColumn("same_mask", (F.col("lost") == 0) & (F.col("gained") == 0))


# -- queries ----------------------------------------------------------------


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


_FOLDERS, _ENDINGS = ["", "01_La", "03_Ae", "06_Ra", "misc"], [".las", ".LAZ", ".tif", ".tiff", ".geojson", ".tif.part", ".~x.tif"]
_PLACES = ["LA_points", "Карты LiDAR", "LiDAR cloud", "li_relief", "AE_2020", "Аэро", "Разметка", "misc"]
_REGION = (2e6, 0.0, 9e6, 1e7)
_LAYERS = ["hillshade_az_315", "hillshade_az_45", "slrm_sigma_5.0", "dtm", "tpi_radius_7", "tri_radius_9"]


def _listing(spark, sf_dir):
    k = F.col("o_orderkey")
    site = F.concat(F.lpad((F.col("o_custkey") % 40).cast("string"), 3, "0"), F.lit("_site"))
    return table(spark, sf_dir, "orders").select(site.alias("site"), _pick(_FOLDERS, k).alias("folder"), F.concat(F.lit("f"), k, _pick(_ENDINGS, k)).alias("name"), F.when(k % 11 == 0, 0).otherwise(k % 1000).cast("long").alias("bytes"))


def q_survey(spark, sf_dir):
    return survey(_listing(spark, sf_dir))


def q_totals(spark, sf_dir):
    return survey_totals(survey(_listing(spark, sf_dir)))


def q_layers(spark, sf_dir):
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select("o_orderkey", _pick(_PLACES, k).alias("folder"), F.concat(F.lit("site_"), k % 5, _pick(_ENDINGS, F.floor(k / 8))).alias("name"))
    return discover_layers(files).select("o_orderkey", "layer")


def q_parameters(spark, sf_dir):
    k = F.col("s_suppkey")
    layers = table(spark, sf_dir, "supplier").select((k % 9).alias("site"), _pick(_LAYERS, F.floor(k / 9)).alias("layer"))
    return relief_parameters(layers).select("site", "parameter", F.array_join(F.col("values").cast("array<decimal(9,1)>").cast("array<string>"), ",").alias("found"))


def q_issues(spark, sf_dir):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    bare = k % 19 == 0
    labels = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k % 12).alias("site"), F.when(k % 17 != 0, _pick(["mound", "pit", "road", "odd"], k)).alias("cls"), F.when(k % 3 == 0, _pick(["mound", "pit"], k)).alias("file_cls"), F.when(k % 5 < 3, F.lit("f")).alias("file"),
        F.when(~bare, (k % 12) * 1e6 + k % 100).alias("x"), F.when(~bare, k % 80 * F.lit(1.0)).alias("y"),
    )
    sources = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), p % 14).alias("site"), F.when(p % 23 != 0, _pick(["mound", "pit", "road"], p)).alias("cls"), F.lit(1).alias("n"))
    return site_issues(labels, sources, ["mound", "pit", "road"], _REGION)


def q_audit(spark, sf_dir):
    masks = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("site"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("cls"), F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") > 40).cast("int")).otherwise(0).alias("seg"), (F.col("l_discount") * 8).alias("hm"))
    return class_audit(masks)


def q_bounds(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = (k * 1000).cast("string"), (k * 700 + F.lit(0.5)).cast("string")
    json = F.concat(F.lit('{"name":"[7,7]","geometry":{"coordinates":[[['), x, F.lit(","), y, F.lit(",3.5],[-1e3, 2000]]]}}"))
    return bounds(table(spark, sf_dir, "supplier").select((k % 10).alias("key"), json.alias("json")), 3857).select("key", *(F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")))


def q_limits(spark, sf_dir):
    k = F.col("p_partkey")
    features = table(spark, sf_dir, "part").select("p_brand", k, F.to_json(F.transform(F.sequence(F.lit(0), (k % 40).cast("int")), lambda v: F.array(v, v + 1))).alias("json")).withColumnRenamed("p_brand", "file")
    files = features.groupBy("file").agg((F.sum("p_partkey") % 1000).alias("bytes"), F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.when(F.min("p_partkey") % 2 == 0, 3857).otherwise(4326)).alias("crs"))
    return submission_limits(files, features, 500, 70, 35)


def q_grids(spark, sf_dir):
    k = F.col("c_custkey")
    grid = lambda move, size: F.struct(F.lit("EPSG:3857").alias("crs"), F.lit(0.5).alias("pixel_size"), (k + move).alias("x_min"), F.lit(0.0).alias("y_min"), size.alias("width"), F.lit(9).alias("height"))
    return table(spark, sf_dir, "customer").select("c_custkey", grids_equal(grid(F.lit(0.0), F.lit(7)), grid(F.when(k % 3 == 0, 1e-3).otherwise(1e-9), F.when(k % 5 == 0, 8).otherwise(7))).alias("same"))


def q_metres(spark, sf_dir):
    pts = points(spark, sf_dir).withColumn("z", F.when(F.col("site") == "R", F.col("z") * 3).otherwise(F.col("z")))
    return to_metres(pts).groupBy("site", "z_unit").agg(F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"), F.round(F.avg("z"), 6).alias("mean"))


def q_attribute(spark, sf_dir):
    return attribute_raster(points(spark, sf_dir), "intensity").select("row", "col", F.round("value", 6).alias("value"), "byte")


def q_verdicts(spark, sf_dir):
    k = F.col("n_nationkey")
    sites = table(spark, sf_dir, "nation").select(k.alias("site"), F.when(k % 7 == 0, 4000).otherwise(10).alias("width"), F.when(k % 7 == 0, 4000).otherwise(10).alias("height"), (k % 5 == 0).alias("built"))
    s = F.col("s_suppkey")
    covered = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), (s % 10).alias("row"), (F.floor(s / 10) % 10).alias("col"))
    return ingest_verdicts(sites, covered).select("site", "pixels", F.round("coverage", 6).alias("coverage"), "build", "reason")


def q_compare(spark, sf_dir):
    cells = with_cells(points(spark, sf_dir)).where("valid").groupBy("site", "row", "col").agg(F.max("z").alias("value")).withColumnRenamed("site", "layer")
    after = cells.where((F.col("row") * 7 + F.col("col")) % 13 != 0).withColumn("value", F.when(F.col("layer") == "A", F.col("value")).when(F.col("col") % 10 == 0, F.col("value") + 0.25).otherwise(F.col("value")))
    return compare_layers(cells, after)


def _sql_pick(values: list[str], at: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({at}) % {len(values)} + 1]"


_FILES = f"""f AS (SELECT lpad((o_custkey % 40)::VARCHAR, 3, '0') || '_site' AS site, {_sql_pick(_FOLDERS, 'o_orderkey')} AS folder, 'f' || o_orderkey || {_sql_pick(_ENDINGS, 'o_orderkey')} AS name, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 1000 END AS bytes FROM orders),
  t AS (SELECT *, name LIKE '%.part' OR name LIKE '%.~%' AS tmp, folder IN ('01_La', '03_Ae', '06_Ra') AS coded, name ILIKE '%.las' OR name ILIKE '%.laz' AS l, name LIKE '%.tif' OR name LIKE '%.tiff' AS r FROM f),
  s AS (SELECT site, count(*) FILTER (l) AS las, count(*) FILTER (r) AS rasters, coalesce(sum(bytes) FILTER (l), 0)::BIGINT AS las_bytes, coalesce(sum(bytes) FILTER (r), 0)::BIGINT AS raster_bytes, count(*) FILTER (tmp) AS temporary,
    count(*) FILTER (coded AND NOT tmp) AS files, coalesce(sum(bytes) FILTER (coded AND NOT tmp), 0)::BIGINT AS bytes, count(*) FILTER (coded AND NOT tmp AND bytes = 0) AS empty,
    coalesce(string_agg(DISTINCT folder[1:2], ',' ORDER BY folder[1:2]) FILTER (coded), '') AS codes, bool_or(l) AND bool_or(r) AS ok FROM t GROUP BY site)"""

QUERIES = {
    "site_survey": q_survey, "survey_totals": q_totals, "discover_layers": q_layers, "relief_parameters": q_parameters, "site_issues": q_issues, "class_audit": q_audit, "json_bounds": q_bounds,
    "submission_limits": q_limits, "grids_equal": q_grids, "z_to_metres": q_metres, "attribute_raster": q_attribute, "ingest_verdicts": q_verdicts, "compare_layers": q_compare,
}
ORACLES = {
    "site_survey": f"WITH {_FILES} SELECT * FROM s",
    "survey_totals": f"WITH {_FILES} SELECT count(*) AS sites, count(*) FILTER (ok) AS ok, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('las', 'rasters', 'las_bytes', 'raster_bytes', 'temporary', 'empty'))} FROM s",
    "discover_layers": f"""WITH f AS (SELECT o_orderkey, o_orderkey % 8 AS p, (o_orderkey % 5)::VARCHAR AS tail, {_sql_pick(_ENDINGS, 'o_orderkey // 8')} AS ending FROM orders),
      l AS (SELECT o_orderkey, CASE WHEN p IN (0, 2) THEN CASE WHEN ending = '.las' THEN 'lidar_points' END WHEN p IN (1, 3) THEN CASE WHEN ending IN ('.tif', '.tiff') THEN 'lidar_' || tail WHEN ending = '.~x.tif' THEN 'lidar_' || tail || '.~x' END
        WHEN p IN (4, 5) THEN CASE WHEN ending IN ('.tif', '.tiff', '.~x.tif') THEN 'aerial' END WHEN p = 6 AND ending = '.geojson' THEN 'annotation_' || tail END AS layer FROM f) SELECT * FROM l WHERE layer IS NOT NULL""",
    "relief_parameters": f"""WITH l AS (SELECT DISTINCT s_suppkey % 9 AS site, {_sql_pick(_LAYERS, 's_suppkey // 9')} AS layer FROM supplier),
      p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in RELIEF.items())}) t(parameter, fallback)),
      v AS (SELECT site, parameter, fallback, CASE WHEN starts_with(layer, parameter || '_') THEN layer[length(parameter) + 2:]::DECIMAL(9, 1) END AS v FROM l, p)
      SELECT site, parameter, coalesce(string_agg(v::VARCHAR, ',' ORDER BY v), any_value(fallback)::DECIMAL(9, 1)::VARCHAR) AS found FROM v GROUP BY site, parameter""",
    "site_issues": f"""WITH r AS (SELECT 's' || s_suppkey % 12 AS site, s_suppkey AS k, CASE WHEN s_suppkey % 17 <> 0 THEN (['mound', 'pit', 'road', 'odd'])[s_suppkey % 4 + 1] END AS cls, CASE WHEN s_suppkey % 3 = 0 THEN (['mound', 'pit'])[s_suppkey % 2 + 1] END AS fc,
        CASE WHEN s_suppkey % 19 <> 0 THEN (s_suppkey % 12) * 1e6 + s_suppkey % 100 END AS x, s_suppkey % 80 AS y FROM supplier),
      l AS (SELECT * FROM r WHERE x IS NOT NULL AND cls IS NOT NULL),
      s AS (SELECT 's' || p_partkey % 14 AS site, CASE WHEN p_partkey % 23 <> 0 THEN (['mound', 'pit', 'road'])[p_partkey % 3 + 1] END AS cls FROM part),
      d AS (SELECT site, cls, sum(w) AS d FROM (SELECT site, cls, 1 AS w FROM l UNION ALL SELECT site, cls, -1 FROM s) GROUP BY ALL),
      a AS (SELECT site, count(*) AS n, count(*) FILTER (fc <> cls) AS fo, count(*) FILTER (cls = 'odd') AS un, count(*) FILTER (k % 5 < 3 AND fc IS NULL) AS odd, min(x) AS w, max(x) AS e, min(y) AS so, max(y) AS no FROM l GROUP BY site),
      b AS (SELECT site, count(*) FILTER (x IS NULL) AS bare, count(*) FILTER (x IS NOT NULL AND cls IS NULL) AS nn FROM r GROUP BY site),
      t AS (SELECT b.*, a.* EXCLUDE (site), e <= 180 AND no <= 90 AS deg, (SELECT sum(d) FROM d WHERE d.site = b.site) AS delta, (SELECT count(*) FROM d WHERE d.site = b.site AND cls IS NOT NULL AND d <> 0) AS classes FROM b LEFT JOIN a ON a.site = b.site)
      SELECT site, 'error' AS level, 'no labels' AS issue, count(*) AS n FROM s WHERE site NOT IN (SELECT site FROM r) GROUP BY site
      UNION ALL SELECT site, 'error', 'count differs', delta::BIGINT FROM t WHERE delta <> 0 UNION ALL SELECT site, 'error', 'classes differ', classes FROM t WHERE classes > 0
      UNION ALL SELECT site, 'error', 'class of another file', fo FROM t WHERE fo > 0 UNION ALL SELECT site, 'error', 'unknown class', un FROM t WHERE un > 0 UNION ALL SELECT site, 'error', 'no class', nn FROM t WHERE nn > 0
      UNION ALL SELECT site, 'error', 'coordinates in degrees', n FROM t WHERE deg UNION ALL SELECT site, 'warning', 'no geometry', bare FROM t WHERE bare > 0 UNION ALL SELECT site, 'warning', 'unrecognised file', odd FROM t WHERE odd > 0
      UNION ALL SELECT site, 'warning', 'source file without class', count(*) FROM s WHERE cls IS NULL AND site IN (SELECT site FROM r) GROUP BY site
      UNION ALL SELECT site, 'warning', 'outside the region', n FROM t WHERE NOT deg AND (w < {_REGION[0]} OR so < {_REGION[1]} OR e > {_REGION[2]} OR no > {_REGION[3]})""",
    "class_audit": """WITH m AS (SELECT l_returnflag AS site, 'c' || l_linenumber AS cls, CASE WHEN l_linenumber < 7 AND l_quantity > 40 THEN 1 ELSE 0 END AS seg, l_discount * 8 AS hm FROM lineitem)
      SELECT site, cls, count(*) FILTER (seg > 0) AS seg_px, count(*) FILTER (hm >= 0.5) AS hm_px, count(*) AS n, count(*) FILTER (seg > 0) / count(*) < 1e-5 AS scarce FROM m GROUP BY GROUPING SETS ((site, cls), (cls))""",
    "json_bounds": """WITH p AS (SELECT s_suppkey % 10 AS key, s_suppkey * 1000.0 AS x, s_suppkey * 700 + 0.5 AS y FROM supplier UNION ALL SELECT s_suppkey % 10, -1000.0, 2000.0 FROM supplier),
      d AS (SELECT key, degrees(x / 6378137::DOUBLE) AS lon, degrees(2 * atan(exp(y / 6378137::DOUBLE)) - pi() / 2) AS lat FROM p)
      SELECT key, round(min(lon), 7) AS west, round(min(lat), 7) AS south, round(max(lon), 7) AS east, round(max(lat), 7) AS north FROM d GROUP BY key""",
    "submission_limits": """WITH f AS (SELECT p_brand AS file, (sum(p_partkey) % 1000)::BIGINT AS bytes, count(*) AS n, count(*) FILTER (p_partkey % 40 >= 35) AS long, min(p_partkey) % 2 = 1 AS other FROM part GROUP BY p_brand)
      SELECT file, 'file too large' AS problem, bytes AS n FROM f WHERE bytes > 500 UNION ALL SELECT file, 'too many features', n FROM f WHERE n > 70
      UNION ALL SELECT file, 'polygons with too many vertices', long FROM f WHERE long > 0 UNION ALL SELECT file, 'another coordinate system', n FROM f WHERE other""",
    "grids_equal": "SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS same FROM customer",
    "z_to_metres": """WITH p AS (SELECT l_returnflag AS site, l_quantity * CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END AS z FROM lineitem), u AS (SELECT site, CASE WHEN max(z) - min(z) > 100 THEN 'feet' ELSE 'meters' END AS z_unit FROM p GROUP BY site)
      SELECT site, z_unit, round(min(z * k), 6) AS low, round(max(z * k), 6) AS high, round(avg(z * k), 6) AS mean FROM (SELECT site, z_unit, z, CASE z_unit WHEN 'feet' THEN 0.3048::DOUBLE ELSE 1 END AS k FROM p JOIN u USING (site)) GROUP BY ALL""",
    "attribute_raster": f"""WITH {POINTS}, t AS (SELECT floor(y)::INT AS row, floor(x)::INT AS col, max(intensity) AS v FROM pts WHERE {INSIDE} GROUP BY ALL),
      g AS (SELECT r.range::INT AS row, c.range::INT AS col, coalesce(v, 0) AS v FROM range(100) r, range(105) c LEFT JOIN t ON t.row = r.range AND t.col = c.range),
      p AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM g WHERE v <> 0)
      SELECT 99 - row AS row, col, round(v, 6) AS value, CASE WHEN v = 0 THEN 0 ELSE floor(greatest(0, least(1, (v - a) / CASE WHEN b > a THEN b - a ELSE 1 END)) * 255)::INT END AS byte FROM g, p""",
    "ingest_verdicts": """WITH c AS (SELECT s_nationkey AS site, count(DISTINCT s_suppkey % 100) AS reached FROM supplier GROUP BY ALL),
      s AS (SELECT n_nationkey AS site, CASE WHEN n_nationkey % 7 = 0 THEN 16000000 ELSE 100 END::BIGINT AS pixels FROM nation),
      v AS (SELECT s.site, pixels, coalesce(reached, 0) / pixels AS coverage FROM s LEFT JOIN c USING (site)),
      r AS (SELECT *, CASE WHEN pixels > 12000000 THEN 'too large' WHEN site % 5 = 0 THEN 'already built' WHEN coverage < 0.05 THEN 'too little coverage' END AS reason FROM v)
      SELECT site, pixels, round(coverage, 6) AS coverage, reason IS NULL AS build, reason FROM r""",
    "compare_layers": f"""WITH {POINTS}, c AS (SELECT site AS layer, floor(y)::INT AS row, floor(x)::INT AS col, max(z) AS a FROM pts WHERE {INSIDE} GROUP BY ALL),
      b AS (SELECT *, CASE WHEN (row * 7 + col) % 13 <> 0 THEN a + CASE WHEN layer <> 'A' AND col % 10 = 0 THEN 0.25 ELSE 0 END END AS b FROM c)
      SELECT layer, count(a) AS n_before, count(b) AS n_after, count(*) - count(b) AS lost, 0::BIGINT AS gained, count(*) FILTER (abs(a - b) > 1e-6) AS changed, coalesce(max(abs(a - b)), 0) AS largest, count(*) = count(b) AS same_mask FROM b GROUP BY layer""",
}
