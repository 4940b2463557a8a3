"""Rasters onto grids of other coordinate systems: averages by area, bilinear and nearest values, canonical grids of sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import from_lon_lat, mercator, to_lon_lat, utm, utm_zone
from ..model import Grid
from ..views import OBJECTS, POINTS, points, truths
from .cells import with_cells

METHODS = ("average", "bilinear", "nearest")


def _epsg(grid: Grid) -> int:
    return int(grid.crs.rsplit(":", 1)[-1])


def reproject(source: int, target: int, x: Column, y: Column) -> tuple[Column, Column]:
    """x, y of one system in another (EPSG:4326, 3857, 326zz, 327zz or 258zz)."""
    return (x, y) if source == target else from_lon_lat(target, *to_lon_lat(source, x, y))


def warp(cells: DataFrame, source: Grid, target: Grid, values: list[str], method: str = "average", keys: tuple[str, ...] = ()) -> DataFrame:
    """*keys, row, col, *values, covered of the target's cells that lie over cells(*keys, row, col, *values) of the source.

    A target cell's window in source cells is the box around its four corners (average), a box of one cell around its
    centre (bilinear), or the cell that holds its centre (nearest). Its value is the mean of the window's cells that
    have one, weighted by the area they share with the window; null where none has. ``covered``: any value is there.

    The target is projected back, cells with a window are joined with the source by row and column, all values at once;
    rows made are the windows' cells, so a window as large as many source cells makes each of those once.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    spark, back = cells.sparkSession, (_epsg(target), _epsg(source))
    frame = target.cells(spark)

    def at(col: Column, row: Column) -> tuple[Column, Column]:
        """Source place (in cells, whole numbers at their lower corners) of a target place."""
        x, y = reproject(*back, target.x_min + col * target.pixel_size, target.y_min + row * target.pixel_size)
        return (x - source.x_min) / source.pixel_size, (y - source.y_min) / source.pixel_size

    if method == "average":
        corners = [at(F.col("col") + i, F.col("row") + j) for i in (0, 1) for j in (0, 1)]
        frame = frame.withColumns({f"{a}{k}": c[n] for k, c in enumerate(corners) for n, a in enumerate("xy")})
        ends = {f"{p}_{a}": f(*(f"{a}{k}" for k in range(4))) for p, f in (("low", F.least), ("high", F.greatest)) for a in "xy"}
    else:
        frame = frame.withColumns(dict(zip("xy", at(F.col("col") + 0.5, F.col("row") + 0.5), strict=True)))
        half = 0.5 if method == "bilinear" else 0.0
        ends = {f"{p}_{a}": (F.col(a) if method == "bilinear" else F.floor(a) + 0.5) + sign * (half or 0.5) for p, sign in (("low", -1), ("high", 1)) for a in "xy"}
    box = frame.select("row", "col", *(c.alias(n) for n, c in ends.items()))

    def span(a: str, size: int) -> Column:
        first, last = F.greatest(F.floor(f"low_{a}"), F.lit(0)), F.least(F.ceil(f"high_{a}") - 1, F.lit(size - 1))
        return F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))

    near = box.withColumn("sr", span("y", source.height)).withColumn("sc", span("x", source.width))
    side = lambda a, c: F.least(F.col(f"high_{a}"), F.col(c) + 1) - F.greatest(F.col(f"low_{a}"), F.col(c))
    near = near.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("sr").alias("row"), F.col("sc").alias("col"), (side("x", "sc") * side("y", "sr")).alias("__w")).where("__w > 0")
    found = cells.select(*keys, "row", "col", *values).join(near, ["row", "col"])
    share = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col("__w") * F.col(v))) / F.sum(F.when(F.col(v).isNotNull(), F.col("__w")))
    out = found.groupBy(*keys, F.col("__row").alias("row"), F.col("__col").alias("col")).agg(*(share(v).alias(v) for v in values))
    there = F.lit(False)
    for v in values:
        there = there | F.col(v).isNotNull()
    return out.withColumn("covered", there)


def coverage(warped: DataFrame, target: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """*keys, n, share of the target's cells that are covered."""
    return warped.groupBy(*keys).agg(F.count_if("covered").alias("n")).withColumn("share", F.col("n") / float(target.width * target.height))


def canonical_grids(places: DataFrame, epsg: int, pixel_size: float = 1.0, pad: int = 64, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """*keys, epsg, x_min, y_min, pixel_size, width, height from places(*keys, x, y): UTM of the zone in which the mean place lies, the box grown by ``pad`` cells and set on whole cells."""
    centre = places.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    lon, lat = to_lon_lat(epsg, F.col("mx"), F.col("my"))
    zones = centre.select(*keys, utm_zone(lon).alias("zone"), (lat < 0).alias("south"))
    east, north = utm(*to_lon_lat(epsg, F.col("x"), F.col("y")), F.col("zone"), F.col("south"))
    ends = places.join(zones, list(keys)).withColumns({"e": east, "n": north}).groupBy(*keys, "zone", "south").agg(*(f(c).alias(f"{p}_{c}") for c in "en" for p, f in (("low", F.min), ("high", F.max))))
    low = lambda c: F.floor((F.col(f"low_{c}") - pad * pixel_size) / pixel_size) * F.lit(float(pixel_size))
    high = lambda c: F.ceil((F.col(f"high_{c}") + pad * pixel_size) / pixel_size) * F.lit(float(pixel_size))
    size = lambda c: F.round((high(c) - low(c)) / pixel_size).cast("int")
    code = F.when(F.col("south"), 32700).otherwise(32600) + F.col("zone")
    return ends.select(*keys, code.cast("int").alias("epsg"), low("e").alias("x_min"), low("n").alias("y_min"), F.lit(float(pixel_size)).alias("pixel_size"), size("e").alias("width"), size("n").alias("height"))


#: Frames of the queries: cells of a thousandth of a degree onto cells of 250 units of EPSG:3857.
DEGREES = Grid(30.0, 50.0, 0.001, 105, 100, "EPSG:4326")
METRES = Grid(3_339_500.0, 6_446_300.0, 250.0, 50, 72, "EPSG:3857")


def _rasters(spark, sf_dir):
    binned = with_cells(points(spark, sf_dir)).where("valid").groupBy("site", "row", "col")
    return binned.agg(F.avg("z").alias("z"), F.avg(F.when(F.col("return_number") > 5, F.col("intensity"))).alias("late"))


def _query(method: str):
    def run(spark, sf_dir):
        warped = warp(_rasters(spark, sf_dir), DEGREES, METRES, ["z", "late"], method, ("site",))
        return warped.select("site", "row", "col", F.round("z", 4).alias("z"), F.round("late", 4).alias("late"), "covered")

    return run


def q_coverage(spark, sf_dir):
    warped = warp(_rasters(spark, sf_dir), DEGREES, METRES, ["late"], "average", ("site",))
    return coverage(warped, METRES, ("site",)).select("site", "n", F.round("share", 6).alias("share"))


def q_canonical(spark, sf_dir):
    """Sites of ten objects each, far from the borders of zones and from whole cells."""
    places = truths(spark, sf_dir)
    lon, lat = 3.7 + (F.col("id") % 7) * 6.0 + F.col("cx") / 1000, (F.col("id") % 2) * 80 - 41.3 + F.col("cy") / 1000
    x, y = mercator(lon, lat)
    found = canonical_grids(places.select((F.col("id") % 14).alias("site"), x.alias("x"), y.alias("y")), 3857)
    return found.select("site", "epsg", (F.col("width") > 128).alias("wide"))


QUERIES = {"warp_average": _query("average"), "warp_bilinear": _query("bilinear"), "warp_nearest": _query("nearest"), "warp_coverage": q_coverage, "canonical_grids": q_canonical}


def _sql(method: str) -> str:
    """The same by brute force: every target cell against every source cell that shares an area with its window."""
    place = lambda c, r: (f"(degrees(({METRES.x_min} + ({c}) * {METRES.pixel_size}) / 6378137::DOUBLE) - 30) / 0.001::DOUBLE", f"(degrees(2 * atan(exp(({METRES.y_min} + ({r}) * {METRES.pixel_size}) / 6378137::DOUBLE)) - pi() / 2) - 50) / 0.001::DOUBLE")
    if method == "average":
        (x0, y0), (x1, y1) = place("col", "row"), place("col + 1", "row + 1")
        box = f"{x0} AS x0, {x1} AS x1, {y0} AS y0, {y1} AS y1"
    else:
        x, y = place("col + 0.5::DOUBLE", "row + 0.5::DOUBLE")
        x, y = (x, y) if method == "bilinear" else (f"floor({x}) + 0.5::DOUBLE", f"floor({y}) + 0.5::DOUBLE")
        box = f"{x} - 0.5::DOUBLE AS x0, {x} + 0.5::DOUBLE AS x1, {y} - 0.5::DOUBLE AS y0, {y} + 0.5::DOUBLE AS y1"
    return f"""{POINTS}, s AS (SELECT site, floor(y)::INT AS r, floor(x)::INT AS c, avg(z) AS z, avg(CASE WHEN return_number > 5 THEN intensity END) AS late FROM pts WHERE x >= 0 AND x < 105 AND y >= 0 AND y < 100 GROUP BY ALL),
      t AS (SELECT row, col, {box} FROM (SELECT r.range::INT AS row, c.range::INT AS col FROM range({METRES.height}) r, range({METRES.width}) c)),
      j AS (SELECT site, row, col, z, late, (least(x1, c + 1) - greatest(x0, c)) * (least(y1, r + 1) - greatest(y0, r)) AS w FROM t JOIN s ON c + 1 > x0 AND c < x1 AND r + 1 > y0 AND r < y1),
      w AS (SELECT site, row, col, sum(w * z) FILTER (z IS NOT NULL) / sum(w) FILTER (z IS NOT NULL) AS z, sum(w * late) FILTER (late IS NOT NULL) / sum(w) FILTER (late IS NOT NULL) AS late FROM j GROUP BY ALL)"""


ORACLES = {
    f"warp_{m}": f"WITH {_sql(m)} SELECT site, row, col, round(z, 4) AS z, round(late, 4) AS late, z IS NOT NULL OR late IS NOT NULL AS covered FROM w" for m in METHODS
} | {
    "warp_coverage": f"WITH {_sql('average')} SELECT site, count(*) FILTER (late IS NOT NULL) AS n, round(count(*) FILTER (late IS NOT NULL) / {METRES.width * METRES.height}::DOUBLE, 6) AS share FROM w GROUP BY site",
    "canonical_grids": f"""WITH {OBJECTS}, p AS (SELECT id % 14 AS site, 3.7::DOUBLE + (id % 7) * 6 + cx / 1000 AS lon, (id % 2) * 80 - 41.3::DOUBLE + cy / 1000 AS lat FROM gt)
      SELECT site, (CASE WHEN avg(lat) < 0 THEN 32700 ELSE 32600 END + floor((avg(lon) + 180) / 6) + 1)::INT AS epsg, count(*) > 0 AS wide FROM p GROUP BY site""",
}
