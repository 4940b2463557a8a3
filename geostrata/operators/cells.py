"""Points to cells: cell index, binning, cloud features, summaries, stacking, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..model import BROADCAST_SITES, GRID, Frame
from ..views import INSIDE, POINTS, points
from .quantiles import percentiles

RELIEF_WORDS = ("slope", "aspect", "hillshade", "slrm", "openness", "sky_view_factor", "curvature", "tpi", "tri")
CLOUD_WORDS = ("point_density", "mean_intensity", "std_intensity", "non_first_return_ratio", "mean_return_number", "mean_z", "z_std")


def with_cells(pts: DataFrame, grid: Frame = GRID) -> DataFrame:
    """Adds col, row and valid; points outside get -1. With ``SiteGrids`` each site has its own frame, and points of other sites are left out."""
    return grid.detach(_with_cells(pts, grid))


def _with_cells(pts: DataFrame, grid: Frame) -> DataFrame:
    inside = grid.holds(F.col("x"), F.col("y"))
    return grid.attach(pts).withColumns({"valid": inside, "col": F.when(inside, grid.col(F.col("x"))).otherwise(-1).cast("int"), "row": F.when(inside, grid.row(F.col("y"))).otherwise(-1).cast("int")})


def grid_from_bounds(pts: DataFrame, pixel_size: float) -> DataFrame:
    """The frame that covers all points: one row x_min, y_min, width, height."""
    found = pts.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return found.select("x_min", "y_min", F.ceil((F.col("x_max") - F.col("x_min")) / pixel_size).cast("int").alias("width"), F.ceil((F.col("y_max") - F.col("y_min")) / pixel_size).cast("int").alias("height"))


def bin_points(pts: DataFrame, grid: Frame = GRID, statistic: str = "mean") -> DataFrame:
    """row, col, value, n for every cell with points."""
    kinds = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}
    if statistic not in kinds:
        raise ValueError(f"unknown statistic: {statistic}")
    return with_cells(pts, grid).where("valid").groupBy(*grid.keys, "row", "col").agg(kinds[statistic]("z").alias("value"), F.count("*").alias("n"))


def cloud_features(pts: DataFrame, grid: Frame = GRID) -> DataFrame:
    """All seven features of every cell with points, in one aggregate."""
    size = F.max(grid.pixel_size) if grid.keys else F.lit(grid.pixel_size)
    return (
        _with_cells(pts, grid)
        .where("valid")
        .groupBy(*grid.keys, "row", "col")
        .agg(
            (F.count("*") / (size * size)).alias("point_density"),
            F.avg("intensity").alias("mean_intensity"),
            F.stddev_pop("intensity").alias("std_intensity"),
            F.avg((F.col("return_number") > 1).cast("double")).alias("non_first_return_ratio"),
            F.avg("return_number").alias("mean_return_number"),
            F.avg("z").alias("mean_z"),
            F.stddev_pop("z").alias("z_std"),
        )
    )


def summarize(pts: DataFrame, bins: int = 16) -> DataFrame:
    """A point cloud's inventory as (kind, key, value): bounds, density, intensity histogram, class counts, share of later returns."""
    base = pts.agg(
        *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z", "intensity")),
        F.count("*").cast("double").alias("n"),
        F.avg((F.col("return_number") > 1).cast("double")).alias("non_first_ratio"),
    )
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    wide = base.withColumn("density", F.when(area > 0, F.col("n") / area))
    facts = wide.unpivot([], [c for c in wide.columns], "key", "value").select(F.lit("fact").alias("kind"), "key", "value")
    span = F.broadcast(base.select("min_intensity", "max_intensity"))  # one row
    place = F.floor((F.col("intensity") - F.col("min_intensity")) / (F.col("max_intensity") - F.col("min_intensity")) * bins)
    place = F.when(F.col("max_intensity") > F.col("min_intensity"), F.least(place, F.lit(bins - 1))).otherwise(0)
    hist = pts.join(span).groupBy(place.cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
    classes = pts.groupBy(F.col("classification").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return facts.unionByName(hist.select(F.lit("intensity").alias("kind"), "key", "value")).unionByName(classes.select(F.lit("class").alias("kind"), "key", "value"))


def channel_order(names: DataFrame) -> DataFrame:
    """name, place: elevation first, then relief, cloud and other layers, each by name."""
    base = F.regexp_extract("name", "^([a-z_]*[a-z])", 1)
    group = F.when(F.col("name") == "dtm", 0).when(F.exists(F.array(*map(F.lit, RELIEF_WORDS)), lambda w: F.startswith(base, w)), 1).when(F.col("name").isin(*CLOUD_WORDS), 2).otherwise(3)
    return names.select("name", (F.row_number().over(Window.orderBy(group, "name")) - 1).alias("place"))


def stack_layers(cells: DataFrame, channels: list[str]) -> DataFrame:
    """cells(row, col, layer, value) to one array of channels for each pixel; nodata and missing channels are 0."""
    wide = cells.where(F.col("layer").isin(channels)).groupBy("row", "col").pivot("layer", channels).agg(F.first("value"))
    return wide.select("row", "col", F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in channels)).alias("channels"))


def channel_mask(cells: DataFrame, channels: list[str]) -> DataFrame:
    """channel, present: whether any cell has the layer."""
    wanted = cells.sparkSession.createDataFrame([(c, k) for k, c in enumerate(channels)], "layer string, place int")
    seen = cells.select("layer").distinct().withColumn("present", F.lit(True))
    return wanted.join(seen, "layer", "left").select(F.col("layer").alias("channel"), "place", F.coalesce("present", F.lit(False)).alias("present"))


def normalize(cells: DataFrame, group: str = "layer", limit: float = 8.0) -> DataFrame:
    """(value - median) / (p98 - p2), clipped, by group; a scale below 1e-6 counts as 1."""
    parts = cut(percentiles(cells, (group,), "value", [0.02, 0.5, 0.98]))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_SITES else parts
    scale = F.col("p")[2] - F.col("p")[0]
    scaled = (F.col("value") - F.col("p")[1]) / F.when(scale < 1e-6, 1.0).otherwise(scale)
    return cells.join(parts, group).withColumn("normalized", F.greatest(F.lit(-limit), F.least(F.lit(limit), scaled))).drop("p")


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def q_cell_index(spark, sf_dir):
    pts = with_cells(points(spark, sf_dir))
    px, py = GRID.pixel(F.col("x"), F.col("y"))
    return pts.select("x", "y", "col", "row", "valid", GRID.contains(F.col("x"), F.col("y")).alias("closed"), F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


def q_grid_from_bounds(spark, sf_dir):
    return grid_from_bounds(points(spark, sf_dir), 0.5)


def _binned(statistic):
    def run(spark, sf_dir):
        return bin_points(points(spark, sf_dir), GRID, statistic).select("row", "col", F.round("value", 6).alias("value"), "n")

    return run


def q_cloud_features(spark, sf_dir):
    return cloud_features(points(spark, sf_dir)).select("row", "col", *_r(*CLOUD_WORDS))


def q_summary(spark, sf_dir):
    return summarize(points(spark, sf_dir)).select("kind", "key", F.round("value", 6).alias("value"))


def _long(spark, sf_dir):
    found = cloud_features(points(spark, sf_dir))
    return found.unpivot(["row", "col"], ["point_density", "mean_z", "z_std"], "layer", "value")


def q_stack(spark, sf_dir):
    return stack_layers(_long(spark, sf_dir), ["mean_z", "absent", "point_density"]).select("row", "col", *(F.round(F.col("channels")[k], 6).alias(f"c{k}") for k in range(3)))


def q_mask(spark, sf_dir):
    return channel_mask(_long(spark, sf_dir), ["mean_z", "absent", "point_density"])


def q_order(spark, sf_dir):
    names = ["tri_3", "dtm", "rgb_r", "mean_z", "slope", "hillshade_45", "hillshade_135", "point_density", "magnetics", "tpi_5", "slrm_2"]
    return channel_order(spark.createDataFrame([(n,) for n in names], "name string"))


def q_normalize(spark, sf_dir):
    return normalize(_long(spark, sf_dir)).select("row", "col", "layer", *_r("normalized"))


def q_normalize_group(spark, sf_dir):
    joint = _long(spark, sf_dir).withColumn("norm_group", F.when(F.col("layer").isin("mean_z", "z_std"), "joint").otherwise(F.col("layer")))
    return normalize(joint, "norm_group").select("row", "col", "layer", *_r("normalized"))


QUERIES = {
    "cell_index": q_cell_index,
    "grid_from_bounds": q_grid_from_bounds,
    "bin_mean": _binned("mean"),
    "bin_min": _binned("min"),
    "bin_median": _binned("median"),
    "cloud_features": q_cloud_features,
    "point_summary": q_summary,
    "stack_layers": q_stack,
    "channel_mask": q_mask,
    "channel_order": q_order,
    "normalize_layers": q_normalize,
    "normalize_group": q_normalize_group,
}

_BIN = f"WITH {POINTS} SELECT floor(y)::INT AS row, floor(x)::INT AS col, round({{}}, 6) AS value, count(*) AS n FROM pts WHERE {INSIDE} GROUP BY ALL"
_FEATURES = f"""{POINTS}, feat AS (
  SELECT floor(y)::INT AS row, floor(x)::INT AS col, count(*)::DOUBLE AS point_density, avg(intensity) AS mean_intensity,
         stddev_pop(intensity) AS std_intensity, avg((return_number > 1)::INT) AS non_first_return_ratio,
         avg(return_number) AS mean_return_number, avg(z) AS mean_z, stddev_pop(z) AS z_std
  FROM pts WHERE {INSIDE} GROUP BY ALL
), long AS (
  SELECT row, col, 'point_density' AS layer, point_density AS value FROM feat UNION ALL
  SELECT row, col, 'mean_z', mean_z FROM feat UNION ALL SELECT row, col, 'z_std', z_std FROM feat
)"""
_NORMAL = f"""WITH {_FEATURES}, q AS (
  SELECT {{0}} AS grp, quantile_cont(value, [0.02, 0.5, 0.98]) AS p FROM long GROUP BY 1
)
SELECT row, col, layer, round(greatest(-8, least(8, (value - p[2]) / CASE WHEN p[3] - p[1] < 1e-6 THEN 1 ELSE p[3] - p[1] END)), 6) AS normalized
FROM long JOIN q ON q.grp = {{0}}"""

ORACLES = {
    "cell_index": f"""WITH {POINTS} SELECT x, y, CASE WHEN {INSIDE} THEN floor(x)::INT ELSE -1 END AS col,
        CASE WHEN {INSIDE} THEN floor(y)::INT ELSE -1 END AS row, ({INSIDE}) AS valid,
        x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 100 AS closed, round(x - 0.5, 6) AS px, round(y - 0.5, 6) AS py FROM pts""",
    "grid_from_bounds": f"WITH {POINTS} SELECT min(x) AS x_min, min(y) AS y_min, ceil((max(x) - min(x)) / 0.5::DOUBLE)::INT AS width, ceil((max(y) - min(y)) / 0.5::DOUBLE)::INT AS height FROM pts",
    "bin_mean": _BIN.format("avg(z)"),
    "bin_min": _BIN.format("min(z)"),
    "bin_median": _BIN.format("median(z)"),
    "cloud_features": f"WITH {_FEATURES} SELECT row, col, {', '.join(f'round({c}, 6) AS {c}' for c in CLOUD_WORDS)} FROM feat",
    "point_summary": f"""WITH {POINTS}, b AS (
        SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
               min(intensity) AS min_intensity, max(intensity) AS max_intensity, count(*)::DOUBLE AS n, avg((return_number > 1)::INT) AS r FROM pts
      ), f AS (
        SELECT 'fact' AS kind, unnest(['min_x', 'min_y', 'min_z', 'min_intensity', 'max_x', 'max_y', 'max_z', 'max_intensity', 'n', 'non_first_ratio', 'density']) AS key,
               unnest([min_x, min_y, min_z, min_intensity, max_x, max_y, max_z, max_intensity, n, r, n / ((max_x - min_x) * (max_y - min_y))]) AS value FROM b
        UNION ALL
        SELECT 'intensity', least(floor((intensity - min_intensity) / (max_intensity - min_intensity) * 16)::INT, 15)::VARCHAR, count(*)::DOUBLE FROM pts, b GROUP BY 2
        UNION ALL
        SELECT 'class', classification, count(*)::DOUBLE FROM pts GROUP BY 2
      ) SELECT kind, key, round(value, 6) AS value FROM f""",
    "stack_layers": f"WITH {_FEATURES} SELECT row, col, round(mean_z, 6) AS c0, 0::DOUBLE AS c1, round(point_density, 6) AS c2 FROM feat",
    "channel_mask": "SELECT * FROM (VALUES ('mean_z', 0, true), ('absent', 1, false), ('point_density', 2, true)) t(channel, place, present)",
    "channel_order": """SELECT name, (row_number() OVER (ORDER BY CASE WHEN name = 'dtm' THEN 0 WHEN regexp_matches(name, '^(slope|hillshade|slrm|tpi|tri)') THEN 1
        WHEN name IN ('mean_z', 'point_density') THEN 2 ELSE 3 END, name) - 1)::INT AS place
      FROM (VALUES ('tri_3'), ('dtm'), ('rgb_r'), ('mean_z'), ('slope'), ('hillshade_45'), ('hillshade_135'), ('point_density'), ('magnetics'), ('tpi_5'), ('slrm_2')) t(name)""",
    "normalize_layers": _NORMAL.format("layer"),
    "normalize_group": _NORMAL.format("CASE WHEN layer IN ('mean_z', 'z_std') THEN 'joint' ELSE layer END"),
}
