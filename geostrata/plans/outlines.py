"""From probabilities of many sites to polygons in GeoJSON: parts cut at peaks and outlined with their holes, circles around peaks, suppression, limits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..model import SiteGrids
from ..operators.cells import with_cells
from ..operators.geometry import centroid, signed_area, vectorize
from ..operators.matching import nms
from ..operators.rasters import close_mask, peaks
from ..sources.geojson import write_by
from ..views import INSIDE, POINTS, points, table


@dataclass(frozen=True)
class Outlining:
    """Parameters; lengths are in cells. The defaults are fixed values."""

    mask_threshold: float = 0.5
    bump_threshold: float = 0.3
    window: int = 7
    min_area: int = 16
    tolerance: float = 0.5
    radius: float = 4.0
    vertices: int = 16
    apart: float = 6.0
    limit: int = 2000

    def __post_init__(self) -> None:
        if not (0 < self.mask_threshold < 1 and 0 < self.bump_threshold < 1):
            raise ValueError("thresholds lie between 0 and 1")
        if self.window < 3 or self.window % 2 == 0 or self.vertices < 3 or self.limit < 1:
            raise ValueError("the window is odd and at least 3, a circle has at least 3 vertices, the limit is positive")


def outline_objects(probs: DataFrame, grids: SiteGrids, classes: list[str], given: Outlining = Outlining(), valid: DataFrame | None = None) -> DataFrame:
    """site, feat_id, cls, score, geom_type, rings (world coordinates), n_cells (null for circles) of ``probs(site, cls, row, col, seg, hm)``, dense cells of every site and class.

    Parts of seg become polygons with holes, cut where they hold several peaks of hm; every peak of hm becomes a circle.
    Of objects of a class whose centres lie close, the best stays; of a site, the ``limit`` best (ties by feat_id: the class's
    place, polygons first, row, column). ``valid(site, row, col, valid)``, dense, is closed by two cells and then leaves out
    what isn't valid. Rows below 2**27 and columns below 2**28, at most 127 classes. No probabilities, or none above a
    threshold: no rows.
    """
    if len(set(classes)) < len(classes) or len(classes) > 127:
        raise ValueError("classes are named once, 127 at most")
    cells = probs.where(F.col("cls").isin(classes)).select("site", "cls", "row", "col", "seg", "hm")
    if valid is not None:
        measured = close_mask(valid, "valid", 2, grids).where("closed = 1").select("site", "row", "col", F.lit(True).alias("__in"))
        cells = cells.join(measured, ["site", "row", "col"], "left")
        cells = cells.withColumns({c: F.when(F.col("__in"), F.col(c)).otherwise(0.0) for c in ("seg", "hm")}).drop("__in")
    cells = cut(cells)
    keys = ["site", "cls"]
    tops = cut(peaks(cells.select(*keys, "row", "col", F.col("hm").alias("value")), given.bump_threshold, given.window, ("site", "cls")))
    parts = vectorize(cells.select(*keys, "row", "col", F.col("seg").alias("value")), given.mask_threshold, given.min_area, given.tolerance, tops)
    place = (F.array_position(F.array(*map(F.lit, classes)), F.col("cls")) - 1).cast("long")

    def number(kind: int, row, col):
        return (place * 2 + kind) * (1 << 55) + row.cast("long") * (1 << 28) + col

    cell = F.when(F.col("peak") == 1, F.col("part")).otherwise(F.col("peak"))
    row = F.floor(cell / (1 << 32))
    ring = F.col("rings")[0]
    # of further rings only those that turn the other way are holes; others outline pieces that a cut has left apart
    holes = F.filter(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: F.signum(signed_area(r)) == -F.signum(signed_area(ring)))
    polygons = parts.where(F.size("rings") > 0).select("site", number(0, row, cell - row * (1 << 32)).alias("id"), "cls", "score", "n_cells", F.concat(F.array(ring), holes).alias("rings"), centroid(ring).alias("at"))
    turns = [2 * math.pi * i / given.vertices for i in range(given.vertices)]
    circle = F.array(*(F.struct((F.col("sub_col") + given.radius * math.cos(t)).alias("x"), (F.col("sub_row") + given.radius * math.sin(t)).alias("y")) for t in turns))
    centre = F.struct(F.col("sub_col").alias("x"), F.col("sub_row").alias("y"))
    circles = tops.select("site", number(1, F.col("row"), F.col("col")).alias("id"), "cls", F.col("value").alias("score"), F.lit(None).cast("long").alias("n_cells"), F.array(circle).alias("rings"), centre.alias("at"))
    found = cut(polygons.unionByName(circles).withColumns({"cx": F.col("at")["x"], "cy": F.col("at")["y"]}).drop("at"))
    stay = nms(found.select("site", "id", "cls", "score", "cx", "cy"), given.apart, ("site",)).select("site", "id")
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "id"))
    kept = found.join(stay, ["site", "id"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= given.limit)
    world = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(*(v.alias(n) for n, v in zip("xy", grids.world(p["x"], p["y"]), strict=True)))))
    placed = grids.attach(kept)
    return grids.detach(placed.select("*", world.alias("world"))).select("site", F.col("id").alias("feat_id"), "cls", "score", F.lit("Polygon").alias("geom_type"), F.col("world").alias("rings"), "n_cells")


def write_objects(found: DataFrame, grids: SiteGrids, path: str, crs: str = "EPSG:3857", class_key: str = "class") -> None:
    """One collection for each site of ``grids`` below ``path`` (``site=...``), an empty one where nothing was found."""
    write_by(found, grids.table.select("site"), "site", path, crs, class_key)


# -- queries ------------------------------------------------------------------

#: Sites of the queries: one for each letter of the points, in cells of 2 units.
SIDE, ROWS, COLS = 2.0, 50, 53


def _grids(spark, sf_dir) -> SiteGrids:
    names = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("site")).distinct()
    return SiteGrids(names.select("site", F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(SIDE).alias("pixel_size"), F.lit(COLS).alias("width"), F.lit(ROWS).alias("height")))


def _probabilities(spark, sf_dir) -> tuple[DataFrame, SiteGrids]:
    """Mean height and intensity of cells as probabilities of two classes of objects."""
    grids = _grids(spark, sf_dir)
    inside = points(spark, sf_dir).where(INSIDE)
    means = with_cells(inside, grids).where("valid").groupBy("site", "row", "col").agg(F.avg(F.col("z") / 50).alias("a"), F.avg(F.col("intensity") / 100).alias("b"))
    dense = grids.cells(spark).join(means, ["site", "row", "col"], "left").na.fill(0.0, ["a", "b"])
    both = F.array(*(F.struct(F.lit(c).alias("cls"), F.round(s, 6).alias("seg"), F.round(h, 6).alias("hm")) for c, s, h in (("high", "a", "b"), ("bright", "b", "a"))))
    return dense.select("site", "row", "col", F.inline(both)), grids


def q_parts(spark, sf_dir):
    """Parts cut at peaks, outlined without simplification: places of the lines and numbers of their vertices."""
    probs, _ = _probabilities(spark, sf_dir)
    probs = cut(probs)
    tops = peaks(probs.select("site", "cls", "row", "col", F.col("hm").alias("value")), 0.6, 7, ("site", "cls"))
    found = vectorize(probs.select("site", "cls", "row", "col", F.col("seg").alias("value")), 0.55, 9, 0.0, tops)
    every = F.flatten("rings")
    ends = {"west": F.array_min, "east": F.array_max}
    over = {n: F.round(f(F.transform(every, lambda p: p["x"])) + 1e-8, 5) for n, f in ends.items()} | {n: F.round(f(F.transform(every, lambda p: p["y"])) + 1e-8, 5) for n, f in zip(("south", "north"), ends.values(), strict=True)}
    return found.select("site", "cls", "part", "peak", "n_cells", F.round("score", 6).alias("score"), F.size(every).cast("long").alias("vertices"), *(v.alias(n) for n, v in over.items()))


def q_objects(spark, sf_dir):
    """The whole plan, with a mask of cells that hold a point; circles' and polygons' areas and centres."""
    probs, grids = _probabilities(spark, sf_dir)
    seen = with_cells(points(spark, sf_dir).where(INSIDE), grids).where("valid").select("site", "row", "col").distinct().withColumn("valid", F.lit(True))
    valid = grids.cells(spark).join(seen, ["site", "row", "col"], "left").na.fill(False, ["valid"])
    found = outline_objects(probs, grids, ["high", "bright"], Outlining(mask_threshold=0.55, bump_threshold=0.6, min_area=9, limit=500), valid)
    ring = F.col("rings")[0]
    return found.select("site", "feat_id", "cls", F.round("score", 6).alias("score"), "n_cells", F.size("rings").alias("n_rings"), F.round(signed_area(ring), 4).alias("area"), F.round(centroid(ring)["x"], 4).alias("x"), F.round(centroid(ring)["y"], 4).alias("y"))


QUERIES = {"outline_parts": q_parts, "outline_objects": q_objects}
#: Parts are found by flooding, a cell's peak by all peaks of its part; a line has one vertex for each side of a cell whose neighbour isn't of its own.
ORACLES = {
    "outline_parts": f"""WITH RECURSIVE {POINTS}, m AS (SELECT site, floor(y / 2)::INT AS row, floor(x / 2)::INT AS col, avg(z / 50) AS a, avg(intensity / 100) AS b FROM pts WHERE {INSIDE} GROUP BY ALL),
      g AS (SELECT site, r.range::INT AS row, c.range::INT AS col FROM (SELECT DISTINCT site FROM pts), range({ROWS}) r, range({COLS}) c),
      d AS (SELECT g.site, g.row, g.col, round(coalesce(a, 0), 6) AS a, round(coalesce(b, 0), 6) AS b FROM g LEFT JOIN m ON m.site = g.site AND m.row = g.row AND m.col = g.col),
      p AS MATERIALIZED (SELECT site, 'high' AS cls, row, col, a AS seg, b AS hm FROM d UNION ALL SELECT site, 'bright', row, col, b, a FROM d),
      h AS MATERIALIZED (SELECT site, cls, row, col, row * 4294967296 + col AS id FROM p WHERE seg >= 0.55),
      e AS MATERIALIZED (SELECT x.site, x.cls, x.id AS u, y.id AS v FROM h x JOIN h y ON x.site = y.site AND x.cls = y.cls AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1),
      reach(site, cls, id, seen) AS (SELECT site, cls, id, id FROM h UNION SELECT e.site, e.cls, e.v, reach.seen FROM reach JOIN e ON e.site = reach.site AND e.cls = reach.cls AND e.u = reach.id AND reach.seen < e.v),
      part AS MATERIALIZED (SELECT h.*, q.part FROM h JOIN (SELECT site, cls, id, min(seen) AS part FROM reach GROUP BY ALL) q USING (site, cls, id)),
      top AS (SELECT x.site, x.cls, x.row, x.col FROM p x JOIN p y ON x.site = y.site AND x.cls = y.cls AND abs(x.row - y.row) <= 3 AND abs(x.col - y.col) <= 3 WHERE x.hm >= 0.6 GROUP BY ALL HAVING any_value(x.hm) >= max(y.hm)),
      tp AS (SELECT part.site, part.cls, part.part, id, part.row, part.col, count(*) OVER (PARTITION BY part.site, part.cls, part.part) AS n FROM part JOIN top USING (site, cls, row, col)),
      near AS (SELECT c.site, c.cls, c.id, min_by(t.id, ((c.row - t.row) ** 2 + (c.col - t.col) ** 2)::BIGINT * 10000 + t.row * 100 + t.col) AS peak FROM part c JOIN tp t ON c.site = t.site AND c.cls = t.cls AND c.part = t.part AND n > 1 GROUP BY ALL),
      own AS MATERIALIZED (SELECT part.site, part.cls, part.row, part.col, part, coalesce(peak, 1)::BIGINT AS peak, seg FROM part LEFT JOIN near USING (site, cls, id) JOIN p ON p.site = part.site AND p.cls = part.cls AND p.row = part.row AND p.col = part.col),
      s AS (SELECT o.*, dr, dc, CASE WHEN q.seg < 0.55 THEN q.seg ELSE 0 END AS low FROM own o CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) k(dr, dc)
        LEFT JOIN p q ON q.site = o.site AND q.cls = o.cls AND q.row = o.row + dr AND q.col = o.col + dc LEFT JOIN own w ON w.site = o.site AND w.cls = o.cls AND w.row = o.row + dr AND w.col = o.col + dc AND w.part = o.part AND w.peak = o.peak WHERE w.site IS NULL),
      v AS (SELECT site, cls, part, peak, count(*) AS vertices, round(min(col + dc * t) + 1e-8::DOUBLE, 5) AS west, round(max(col + dc * t) + 1e-8::DOUBLE, 5) AS east, round(min(row + dr * t) + 1e-8::DOUBLE, 5) AS south, round(max(row + dr * t) + 1e-8::DOUBLE, 5) AS north
        FROM (SELECT *, (seg - 0.55::DOUBLE) / (seg - coalesce(low, 0)) AS t FROM s) GROUP BY ALL)
      SELECT site, cls, part, peak, n_cells, score, vertices, west, east, south, north FROM v JOIN (SELECT site, cls, part, peak, count(*) AS n_cells, round(avg(seg), 6) AS score FROM own GROUP BY ALL HAVING count(*) >= 9) USING (site, cls, part, peak)""",
}
