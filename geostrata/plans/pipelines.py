"""Whole pipelines: points to layers, probabilities to detections, detections to a report."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.window2d import gaussian_weights
from ..model import GRID, Frame, Grid
from ..operators.cells import CLOUD_WORDS, cloud_features
from ..operators.matching import _ERRORS, NEAR, _objects, errors, evaluate, match, nms
from ..operators.rasters import _sub, peaks, stitch, tile_cells, tile_index
from ..operators.ground import MARKED, filter_ground
from ..operators.terrain import Relief, build_dtm, elevation, fill_idw, hillshade, relief_layers, slope_aspect, tpi_tri
from ..operators.terrain import _blur as blur, _idw as idw
from ..views import DENSE, INSIDE, points


def layer_key(name: str, params: dict, grid: Grid, code: str = "1") -> str:
    """Content address of a layer: changes with name, parameters, grid or code, not with the order of keys."""
    return hashlib.sha256(json.dumps([code, name, params, grid.__dict__], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _folder(spark, path: str):
    """The path in Hadoop's terms, and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def cached_layer(spark, root: str, name: str, params: dict, grid: Grid, make) -> DataFrame:
    """The layer below root, made and written first if it isn't there; Spark's committer makes the write whole or absent."""
    path = f"{root}/{name}/{layer_key(name, params, grid)}"
    done, fs = _folder(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def list_layers(spark, root: str) -> DataFrame:
    """layer, key, bytes, files, modified of the whole layers below root, from the listing alone; none: no rows."""
    pattern, fs = _folder(spark, f"{root}/*/*/_SUCCESS")
    entries = []
    for status in fs.globStatus(pattern) or []:
        folder = status.getPath().getParent()
        size = fs.getContentSummary(folder)
        entries.append((folder.getParent().getName(), folder.getName(), size.getLength(), size.getFileCount(), status.getModificationTime()))
    found = spark.createDataFrame(entries, "layer string, key string, bytes long, files long, at long")
    return found.withColumn("modified", F.timestamp_millis("at")).drop("at")


def invalidate(spark, root: str, name: str | None = None) -> int:
    """Removes the layers of a name, or all, below root; how many there were."""
    gone = [row.layer for row in list_layers(spark, root).collect() if name in (None, row.layer)]
    for layer in set(gone):
        path, fs = _folder(spark, f"{root}/{layer}")
        fs.delete(path, True)
    return len(gone)


def build_site(pts: DataFrame, grid: Frame = GRID) -> DataFrame:
    """One row for each cell (of each site, with ``SiteGrids``), of all returns without a ground filter: elevation, slope, hillshade, tpi, tri and the cloud features."""
    sloped = grid.detach(slope_aspect(grid.attach(elevation(pts, grid)), grid.pixel_size, keys=grid.keys))
    relief = tpi_tri(sloped, 3, grid).withColumn("shade_315", hillshade(315))
    return relief.join(cloud_features(pts, grid), [*grid.keys, "row", "col"], "left")


def site_layers(pts: DataFrame, grid: Frame = GRID, preset: str = "soft", cell: float = 1.0, relief: Relief = Relief(), max_gap: float = 4.0, **dtm) -> DataFrame:
    """All layers of a site (or of each, with ``SiteGrids``), one row for each cell: dtm and hole (no ground point), the relief layers, the cloud features.

    The model is that of ground points; its holes up to a size are filled (``build_dtm`` and its parameters), then gaps up
    to max_gap cells. What stays null has null relief; cloud features are those of all points.
    """
    marked, _ = filter_ground(pts, preset, cell, keys=grid.keys)
    whole = [*grid.keys, "row", "col"]
    dtm = cut(fill_idw(build_dtm(marked.where("ground"), grid, **dtm), "z", max_gap, keys=grid.keys).drop("observed"))
    layers = dtm.withColumnRenamed("z", "dtm").join(relief_layers(dtm, grid, relief), whole)
    return layers.join(cloud_features(pts, grid), whole, "left")


def detect(probs: DataFrame, tile: int, radius: float, limit: int) -> DataFrame:
    """Detections(id, cls, cx, cy, score) from tile probabilities: stitched, then kept where at least all neighbours, suppressed and limited to the best of all. Classes (0 without a column cls) are rasters of their own."""
    keys = ("cls",) if "cls" in probs.columns else ()
    found = peaks(stitch(probs, tile, keys=keys).withColumn("value", F.round("value", 9)), 0.3, 7, keys)
    cls = F.col("cls") if keys else F.lit(0).alias("cls")
    dets = found.select((F.xxhash64(*keys, "row", "col") if keys else F.col("row").cast("long") * (1 << 32) + F.col("col")).alias("id"), cls, F.col("sub_col").alias("cx"), F.col("sub_row").alias("cy"), F.col("value").alias("score"))
    return nms(dets, radius).orderBy(F.desc("score"), "id").limit(limit)


def report(preds: DataFrame, gts: DataFrame, radius: float, metres: bool = False, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Scores by class and errors by kind (of each site, with keys), of objects such as ``geojson.read`` gives (with an id)."""
    pairs = match(preds, gts, radius=radius, metres=metres, keys=keys)
    return evaluate(preds, gts, pairs, keys), errors(preds, gts, pairs, radius=radius, metres=metres, keys=keys).groupBy(*keys, "kind", "error").count()


def q_build_site(spark, sf_dir):
    found = build_site(points(spark, sf_dir))
    return found.select("row", "col", "observed", *(F.round(c, 5).alias(c) for c in ("z", "slope", "shade_315", "tpi", "tri", *CLOUD_WORDS)))


#: Digits that the query keeps of a layer.
DIGITS = dict.fromkeys(("tri_radius_3", "tri_radius_9"), 4)


def q_site_layers(spark, sf_dir):
    found = site_layers(points(spark, sf_dir), cell=2.0)
    return found.select("row", "col", "n", "hole", *(F.round(c, DIGITS.get(c, 5)).alias(c) for c in ("dtm", *Relief().names(), *CLOUD_WORDS)))


def q_predict(spark, sf_dir):
    """Heights as probabilities, tiled, stitched and turned into detections."""
    cells = elevation(points(spark, sf_dir)).select("row", "col", (F.col("z") / 50).alias("value"))
    found = detect(tile_cells(cells, tile_index(spark, 100, 105, 32, 8)), 32, 6.0, 2000)
    return found.select(F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("score", 6).alias("score"))


def q_report(spark, sf_dir):
    return report(*_objects(spark, sf_dir), NEAR)[1].select("kind", "error", F.col("count").alias("n"))


QUERIES = {"build_site": q_build_site, "site_layers": q_site_layers, "predict_detections": q_predict, "error_report": q_report}


def _weights(name: str, weights: list[float]) -> str:
    return f"{name} AS (SELECT k::INT AS k, w::DOUBLE AS w FROM (VALUES {', '.join(f'({i - len(weights) // 2}, {w!r}::DOUBLE)' for i, w in enumerate(weights))}) t(k, w))"


def _layers_sql() -> str:
    """The query of all layers: runs of holes are joined into parts, kernels are self-joins on clamped offsets."""
    r = Relief()
    parts = [MARKED, f"""c0 AS MATERIALIZED (SELECT g.row, g.col, z, coalesce(n, 0) AS n, z IS NULL AS hole FROM (SELECT r.range::INT AS row, c.range::INT AS col FROM range(100) r, range(105) c) g
        LEFT JOIN (SELECT floor(y)::INT AS row, floor(x)::INT AS col, avg(z) AS z, count(*) AS n FROM marked WHERE ground AND {INSIDE} GROUP BY ALL) q ON g.row = q.row AND g.col = q.col)""",
        "hr AS MATERIALIZED (SELECT row, min(col) AS a, max(col) AS z, row * 1000 + min(col) AS id FROM (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS k FROM c0 WHERE hole) GROUP BY row, k)",
        "adj AS MATERIALIZED (SELECT p.id AS p, q.id AS q FROM hr p JOIN hr q ON abs(p.row - q.row) = 1 AND p.a <= q.z AND q.a <= p.z)",
        "reach(id, seen) AS (SELECT id, id FROM hr UNION SELECT adj.q, reach.seen FROM reach JOIN adj ON adj.p = reach.id AND reach.seen < adj.q)",
        "part AS (SELECT id, min(seen) AS part FROM reach GROUP BY id)",
        "sized AS MATERIALIZED (SELECT hr.row, hr.a, hr.z, sum(hr.z - hr.a + 1) OVER (PARTITION BY part) AS size FROM hr JOIN part USING (id))",
        "c1 AS MATERIALIZED (SELECT c0.*, coalesce(sized.size, 0) AS size FROM c0 LEFT JOIN sized ON c0.row = sized.row AND c0.col BETWEEN sized.a AND sized.z AND c0.hole)",
        idw("i1", "c1", "z IS NULL AND size <= 1000", None),
        "c2 AS MATERIALIZED (SELECT c1.row, c1.col, coalesce(z, f) AS z, n, hole FROM c1 LEFT JOIN i1 ON c1.row = i1.row AND c1.col = i1.col)",
        idw("i2", "c2", "z IS NULL", 4),
        "c3 AS MATERIALIZED (SELECT c2.row, c2.col, coalesce(z, f) AS z, n, hole FROM c2 LEFT JOIN i2 ON c2.row = i2.row AND c2.col = i2.col)",
        """d AS MATERIALIZED (SELECT c3.row, c3.col, coalesce(c3.z, f.z) AS z FROM c3 LEFT JOIN (SELECT h.row, h.col, min_by(k.z, ((k.row - h.row) * (k.row - h.row) + (k.col - h.col) * (k.col - h.col))::BIGINT * 1000000 + k.row * 1000 + k.col) AS z
        FROM (SELECT * FROM c3 WHERE z IS NULL) h, (SELECT * FROM c3 WHERE z IS NOT NULL) k GROUP BY h.row, h.col) f ON c3.row = f.row AND c3.col = f.col)"""]
    value, joins = [], []
    for s in sorted({*r.slrm, *r.curvature}):
        parts += [_weights(f"w{s}", gaussian_weights(s)), blur(f"b{s}", "d", "z", f"w{s}").replace(f"b{s} AS", f"b{s} AS MATERIALIZED")]
        joins.append(f"b{s}")
        if s in r.curvature:
            parts.append(f"""k{s} AS (SELECT row, col, coalesce(lag(v) OVER x, v) + coalesce(lead(v) OVER x, v) + coalesce(lag(v) OVER y, v) + coalesce(lead(v) OVER y, v) - 4 * v AS v FROM b{s}
              WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))""")
            joins.append(f"k{s}")
            value.append((f"curvature_sigma_{s}", f"k{s}.v"))
        if s in r.slrm:
            value.append((f"slrm_sigma_{s}", f"d.z - b{s}.v"))
    for n in sorted({*r.tpi, *r.tri}):
        parts += [_weights(f"v{n}", [1 / (2 * n + 1)] * (2 * n + 1)), blur(f"m{n}x", "d", "z", f"v{n}"), blur(f"q{n}x", "d", "z * z", f"v{n}")]
        joins += [f"m{n}x", f"q{n}x"]
        if n in r.tpi:
            value.append((f"tpi_radius_{n}", f"d.z - m{n}x.v"))
        if n in r.tri:
            value.append((f"tri_radius_{n}", f"sqrt(greatest(q{n}x.v - m{n}x.v * m{n}x.v, 0))"))
    reach, dirs = r.openness
    parts.append(f"""of AS (SELECT e.range AS dir, round_even(s.range * sin(2 * pi() * e.range / {dirs}), 0)::INT AS dr, round_even(s.range * cos(2 * pi() * e.range / {dirs}), 0)::INT AS dc, s.range::DOUBLE AS dist FROM range({dirs}) e, range(1, {reach + 1}) s),
      an AS (SELECT a.row, a.col, dir, max(degrees(atan2(b.z - a.z, dist))) AS up, min(degrees(atan2(b.z - a.z, dist))) AS down FROM d a, of JOIN d b ON b.row = (a.row + dr + 100) % 100 AND b.col = (a.col + dc + 105) % 105 GROUP BY ALL),
      op AS (SELECT row, col, avg(90 - up) AS p, avg(90 + down) AS q FROM an GROUP BY ALL)""")
    parts.append("""e AS (SELECT row, col, z, lag(z) OVER x AS xl, lead(z) OVER x AS xr, lag(z) OVER y AS yl, lead(z) OVER y AS yr FROM d WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
      gr AS (SELECT row, col, CASE WHEN xl IS NULL THEN xr - z WHEN xr IS NULL THEN z - xl ELSE (xr - xl) / 2 END AS gx, CASE WHEN yl IS NULL THEN yr - z WHEN yr IS NULL THEN z - yl ELSE (yr - yl) / 2 END AS gy FROM e),
      sa AS (SELECT row, col, atan(sqrt(gx * gx + gy * gy)) AS s, CASE WHEN gx = 0 AND gy = 0 THEN pi() ELSE atan2(-gx, -gy) END AS a FROM gr)""")
    parts.append(f"""cf AS (SELECT floor(y)::INT AS row, floor(x)::INT AS col, count(*)::DOUBLE AS point_density, avg(intensity) AS mean_intensity, stddev_pop(intensity) AS std_intensity, avg((return_number > 1)::INT) AS non_first_return_ratio,
        avg(return_number) AS mean_return_number, avg(z) AS mean_z, stddev_pop(z) AS z_std FROM pts WHERE {INSIDE} GROUP BY ALL)""")
    shade = "greatest(0, least(1, cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians({0}) - a))) * 255"
    value += [("slope", "degrees(s)"), ("aspect_sin", "sin(a)"), ("aspect_cos", "cos(a)"), *((f"hillshade_az_{z}", shade.format(z)) for z in r.azimuths)]
    value += [("positive_openness", "op.p"), ("negative_openness", "op.q"), ("sky_view_factor", "greatest(0, least(1, op.p / 180))")]
    layers = ", ".join(f"CASE WHEN c3.z IS NOT NULL THEN round({v}, {DIGITS.get(name, 5)}) END AS {name}" for name, v in value)
    tables = " ".join(f"JOIN {t} USING (row, col)" for t in ("d", "sa", "op", *joins))
    return f"""WITH RECURSIVE {', '.join(parts)} SELECT c3.row, c3.col, n, hole, round(c3.z, 5) AS dtm, {layers}, {", ".join(f"round(cf.{c}, 5) AS {c}" for c in CLOUD_WORDS)}
      FROM c3 {tables} LEFT JOIN cf ON c3.row = cf.row AND c3.col = cf.col"""


ORACLES = {
    "site_layers": _layers_sql(),
    "error_report": f"{_ERRORS} SELECT kind, error, count(*) AS n FROM errors GROUP BY ALL",
    "predict_detections": f"""WITH RECURSIVE {DENSE}, h AS (SELECT row, col, round(z / 50, 9) AS z FROM dense),
      m AS (SELECT row, max(z) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t, col, z FROM h), tops AS (SELECT row, col, z, max(t) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM m),
      n AS (SELECT row, col, z, top, lag(z) OVER x AS xl, lead(z) OVER x AS xr, lag(z) OVER y AS yl, lead(z) OVER y AS yr FROM tops
            WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
      p AS (SELECT row::BIGINT * 4294967296 + col AS id, {_sub('col', 'xl', 'xr')} AS cx, {_sub('row', 'yl', 'yr')} AS cy, round(z, 9) AS score FROM n WHERE z >= top - 1e-12 AND z >= 0.3),
      o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM p),
      ahead AS (SELECT b.id, list(a.id) AS by FROM o a JOIN o b ON a.k < b.k AND (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 36 GROUP BY b.id),
      walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT o.k, CASE WHEN list_has_any(coalesce(ahead.by, []), w.kept) THEN w.kept ELSE list_append(w.kept, o.id) END FROM walk w JOIN o ON o.k = w.k + 1 LEFT JOIN ahead ON ahead.id = o.id),
      kept AS (SELECT unnest(arg_max(kept, k)) AS id FROM walk)
      SELECT round(cx, 4) AS cx, round(cy, 4) AS cy, round(score, 6) AS score FROM o JOIN kept USING (id) ORDER BY k LIMIT 2000""",
    "build_site": f"""WITH {DENSE}, e AS (
        SELECT *, lag(z) OVER x AS xl, lead(z) OVER x AS xr, lag(z) OVER y AS yl, lead(z) OVER y AS yr FROM dense WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)
      ), gr AS (SELECT row, col, z, observed, CASE WHEN xl IS NULL THEN xr - z WHEN xr IS NULL THEN z - xl ELSE (xr - xl) / 2 END AS gx, CASE WHEN yl IS NULL THEN yr - z WHEN yr IS NULL THEN z - yl ELSE (yr - yl) / 2 END AS gy FROM e),
      k AS (SELECT r.range::INT - 3 AS dr, c.range::INT - 3 AS dc FROM range(7) r, range(7) c),
      box AS (SELECT a.row, a.col, avg(b.z) AS m, avg(b.z * b.z) AS m2 FROM dense a, k JOIN dense b ON b.row = greatest(0, least(99, a.row + dr)) AND b.col = greatest(0, least(104, a.col + dc)) GROUP BY ALL),
      f AS (SELECT floor(y)::INT AS row, floor(x)::INT AS col, count(*)::DOUBLE AS point_density, avg(intensity) AS mean_intensity, stddev_pop(intensity) AS std_intensity, avg((return_number > 1)::INT) AS non_first_return_ratio,
              avg(return_number) AS mean_return_number, avg(z) AS mean_z, stddev_pop(z) AS z_std FROM pts WHERE {INSIDE} GROUP BY ALL)
      SELECT gr.row, gr.col, observed, round(z, 5) AS z, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope,
        round(greatest(0, least(1, cos(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(315) - CASE WHEN gx = 0 AND gy = 0 THEN pi() ELSE atan2(-gx, -gy) END))) * 255, 5) AS shade_315,
        round(z - m, 5) AS tpi, round(sqrt(greatest(m2 - m * m, 0)), 5) AS tri, {", ".join(f"round({c}, 5) AS {c}" for c in CLOUD_WORDS)}
      FROM gr JOIN box USING (row, col) LEFT JOIN f ON f.row = gr.row AND f.col = gr.col""",
}
