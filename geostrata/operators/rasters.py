"""Spectral indices, alignment, resampling, tiling, stitching, peaks and overlays over long cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shared
from ..functions.window2d import extreme
from ..model import BROADCAST_SITES, GRID, Frame, Grid
from ..views import DENSE, INSIDE, POINTS, full_grid, points
from .cells import bin_points, with_cells
from .quantiles import percentiles
from .terrain import elevation

# -- spectral ---------------------------------------------------------------

#: index: (bands, expression of band columns)
INDICES = {
    "ndvi": (("nir", "red"), lambda: _clip(_normalized("nir", "red"), 1)),
    "gndvi": (("nir", "green"), lambda: _clip(_normalized("nir", "green"), 1)),
    "ndwi": (("green", "nir"), lambda: _clip(_normalized("green", "nir"), 1)),
    "sr": (("nir", "red"), lambda: F.greatest(F.lit(0.0), F.least(F.lit(20.0), _ratio(F.col("nir"), F.col("red"))))),
    "ari": (("green", "red"), lambda: _clip(_ratio(F.lit(1.0), F.col("green")) - _ratio(F.lit(1.0), F.col("red")), 10)),
    "savi": (("nir", "red"), lambda: _clip(_ratio((F.col("nir") - F.col("red")) * 1.5, F.col("nir") + F.col("red") + 0.5), 1.5)),
}


def _ratio(top: Column, below: Column) -> Column:
    return F.when(F.abs(below) < 1e-6, 0.0).otherwise(top / below)


def _normalized(a: str, b: str) -> Column:
    return _ratio(F.col(a) - F.col(b), F.col(a) + F.col(b))


def _clip(value: Column, limit: float) -> Column:
    return F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), value))


def informative(bands: DataFrame, names: list[str], std_min: float = 0.01) -> list[str]:
    """Bands present whose deviation over valid cells reaches std_min (one row of statistics)."""
    there = [n for n in names if n in bands.columns]
    found = bands.agg(*(F.stddev_pop(n).alias(n) for n in there)).first()
    return [n for n in there if found[n] is not None and found[n] >= std_min]


def spectral_indices(bands: DataFrame, std_min: float | None = 0.01) -> tuple[DataFrame, list[str]]:
    """row, col and every index whose bands are informative (std_min None: whose bands are there); and the names skipped. Null bands (nodata) give null."""
    names = ["red", "green", "blue", "nir"]
    good = {n for n in names if n in bands.columns} if std_min is None else set(informative(bands, names, std_min))
    used = {n: make() for n, (need, make) in INDICES.items() if set(need) <= good}
    valid = F.lit(True)
    for b in good:
        valid = valid & F.col(b).isNotNull()
    return bands.select("row", "col", *(F.when(valid, e).alias(n) for n, e in used.items())), sorted(set(INDICES) - set(used))


def stretch(cells: DataFrame, value: str) -> DataFrame:
    """Adds byte: 2 to 98 percentile stretch over non-zero values."""
    p = percentiles(cells.where(F.col(value) != 0), (), value, [0.02, 0.98])
    share = (F.col(value) - F.col("p")[0]) / F.when(F.col("p")[1] > F.col("p")[0], F.col("p")[1] - F.col("p")[0]).otherwise(1.0)
    byte = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255)
    return cells.join(F.broadcast(p), how="left").withColumn("byte", F.when(F.col(value) == 0, 0).otherwise(byte).cast("int")).drop("p")


# -- alignment --------------------------------------------------------------


def estimate_shifts(reference: DataFrame, layers: DataFrame, max_shift: int, grid: Grid = GRID, least: int = 100) -> DataFrame:
    """layer, dx, dy, confidence: the shift of each of ``layers(layer, row, col, value)`` against ``reference(row, col, value)``.

    Normalised cross-correlation over jointly valid cells, cyclic, at the lags up to max_shift. Raster rows become
    arrays, so a lag is one dot product for each pair of rows; equal peaks go to the smallest shift.
    """
    both = layers.join(reference.select("row", "col", F.col("value").alias("va")), ["row", "col"]).where("va is not null and value is not null")
    means = shared.cut(both.groupBy("layer").agg(F.avg("va").alias("ma"), F.avg("value").alias("mb")))
    if means.count() <= BROADCAST_SITES:  # two numbers a layer
        means = F.broadcast(means)
    centred = both.join(means, "layer").select("layer", "row", "col", (F.col("va") - F.col("ma")).alias("a"), (F.col("value") - F.col("mb")).alias("b"))
    line = centred.groupBy("layer", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("a", "b")))).alias("m"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.count("*").alias("n"))
    width = F.sequence(F.lit(0), F.lit(grid.width - 1))
    of = lambda name: F.transform(width, lambda c: F.coalesce(F.try_element_at("m", c)[name], F.lit(0.0)))
    lines = line.select("layer", "row", of("a").alias("a"), of("b").alias("b"))
    lags = F.sequence(F.lit(-max_shift), F.lit(max_shift))
    moved = lines.select("layer", "a", "row", F.explode(lags).alias("dy")).select("layer", "a", "dy", F.pmod(F.col("row") + F.col("dy"), F.lit(grid.height)).alias("row"))
    pairs = moved.join(lines.select("layer", "row", "b"), ["layer", "row"]).select("layer", "dy", "a", "b", F.explode(lags).alias("dx"))
    cut = F.pmod(F.col("dx"), F.lit(grid.width))
    turned = F.concat(F.slice("b", cut + 1, grid.width - cut), F.slice("b", F.lit(1), cut))
    dot = F.aggregate(F.zip_with("a", turned, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    sums = pairs.groupBy("layer", "dx", "dy").agg(F.sum(dot).alias("s"))
    best = sums.groupBy("layer").agg(F.max_by(F.struct("dx", "dy", "s"), F.struct(F.round("s", 6), -F.abs("dx") - F.abs("dy"), -F.col("dx"), -F.col("dy"))).alias("b"))
    norms = line.groupBy("layer").agg(F.sqrt(F.sum("aa") * F.sum("bb")).alias("norm"), F.sum("n").alias("total"))
    known = (F.col("total") >= least) & (F.col("norm") > 0)
    return best.join(norms, "layer").select("layer", F.when(known, F.col("b.dx")).otherwise(0).alias("dx"), F.when(known, F.col("b.dy")).otherwise(0).alias("dy"), F.when(known, F.col("b.s") / F.col("norm")).otherwise(0.0).alias("confidence"))


def estimate_shift(a: DataFrame, b: DataFrame, max_shift: int, grid: Grid = GRID, least: int = 100) -> DataFrame:
    """dx, dy, confidence of b(row, col, value) against a."""
    return estimate_shifts(a, b.select(F.lit("b").alias("layer"), "row", "col", "value"), max_shift, grid, least).drop("layer")


def apply_shift(cells: DataFrame, dx: int, dy: int, grid: Grid = GRID) -> DataFrame:
    """cells(row, col, value) moved by whole cells; vacated ones are null."""
    moved = cells.select((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"), "value").where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return full_grid(cells.sparkSession, grid).join(moved, ["row", "col"], "left")


def resample(cells: DataFrame, source: Grid, target: Grid, method: str = "bilinear") -> DataFrame:
    """row, col, value on the target grid: nearest, bilinear (valid neighbours' weights renormalised) or average of the covered cells."""
    if source.crs != target.crs:
        raise ValueError("resampling keeps the coordinate system")
    spark = cells.sparkSession
    known = cells.where(F.col("value").isNotNull()).select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    x, y = target.world(F.col("col"), F.col("row"))
    px, py = source.pixel(x, y)
    frame = full_grid(spark, target)
    if method == "nearest":
        near = frame.withColumns({"sr": F.floor(py + 0.5).cast("int"), "sc": F.floor(px + 0.5).cast("int")})
        return near.join(known, ["sr", "sc"], "left").select("row", "col", "value")
    if method == "bilinear":
        corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
        around = frame.withColumns({"px": px, "py": py}).withColumn("c", F.explode(corners))
        fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
        weight = F.when(F.col("c.j") == 1, fx).otherwise(1 - fx) * F.when(F.col("c.i") == 1, fy).otherwise(1 - fy)
        around = around.select("row", "col", (F.floor("py") + F.col("c.i")).cast("int").alias("sr"), (F.floor("px") + F.col("c.j")).cast("int").alias("sc"), weight.alias("w")).where("w > 0")
    elif method == "average":
        half = target.pixel_size / source.pixel_size / 2

        def span(at: Column) -> Column:
            return F.sequence(F.floor(at - half + 0.5).cast("int"), F.ceil(at + half - 0.5).cast("int"))

        def cover(at: Column, cell: Column) -> Column:
            return F.greatest(F.lit(0.0), F.least(at + half, cell + 0.5) - F.greatest(at - half, cell - 0.5))

        around = frame.withColumns({"px": px, "py": py}).withColumn("sr", F.explode(span(F.col("py")))).withColumn("sc", F.explode(span(F.col("px"))))
        around = around.select("row", "col", "sr", "sc", (cover(F.col("py"), F.col("sr")) * cover(F.col("px"), F.col("sc"))).alias("w")).where("w > 1e-12")
    else:
        raise ValueError(f"unknown method: {method}")
    sums = around.join(known, ["sr", "sc"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return frame.join(sums, ["row", "col"], "left")


def overlay(cells: DataFrame) -> DataFrame:
    """cells(row, col, value, pixel_size, ord): the finest source that covers a cell wins, the later one among equals."""
    return cells.where(F.col("value").isNotNull()).groupBy("row", "col").agg(F.max_by("value", F.struct(-F.col("pixel_size"), F.col("ord"))).alias("value"))


# -- tiles ------------------------------------------------------------------


def axis_starts(size: int, tile: int, stride: int) -> list[int]:
    if size <= tile:
        return [0]
    return sorted({*range(0, size - tile, stride), size - tile})


def tile_index(spark, height: int, width: int, tile: int, overlap: int) -> DataFrame:
    """tile_id, row0, col0, h, w of overlapping windows; the last of an axis is clamped to the edge."""
    if not 0 <= overlap < tile:
        raise ValueError("the overlap lies between 0 and the tile size")
    rows, cols = axis_starts(height, tile, tile - overlap), axis_starts(width, tile, tile - overlap)
    data = [(k, r, c, min(tile, height), min(tile, width)) for k, (r, c) in enumerate((r, c) for r in rows for c in cols)]
    return spark.createDataFrame(data, "tile_id int, row0 int, col0 int, h int, w int")


def tile_cells(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every cell once for each tile that covers it, with its place in the tile. The index of a raster is small, and joined by row bands."""
    covered = tiles.withColumn("row", F.explode(F.sequence(F.col("row0"), F.col("row0") + F.col("h") - 1)))
    joined = cells.join(covered, "row").where((F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col0") + F.col("w")))
    return joined.withColumns({"i": F.col("row") - F.col("row0"), "j": F.col("col") - F.col("col0")})


def hann(at: Column, size: int, eps: float = 1e-3) -> Column:
    s = F.sin(F.lit(math.pi) * (at + 0.5) / size)
    return F.greatest(s * s, F.lit(eps))


def stitch(parts: DataFrame, tile: int, eps: float = 1e-3, keys: tuple[str, ...] = ()) -> DataFrame:
    """row, col, value: overlap-add of parts(row, col, i, j, value) with Hann weights, for each raster of keys."""
    w = hann(F.col("i"), tile, eps) * hann(F.col("j"), tile, eps)
    return parts.withColumn("wt", w).groupBy(*keys, "row", "col").agg((F.sum(F.col("wt") * F.col("value")) / F.sum("wt")).alias("value"))


def sample_weights(tiles: DataFrame, pos_fraction: float) -> DataFrame:
    """tiles(tile_id, positive) with weight: positives share pos_fraction; all equal if there is one kind only."""
    w = Window.partitionBy()
    pos, n = F.sum(F.col("positive").cast("int")).over(w), F.count("*").over(w)
    mixed = (pos > 0) & (pos < n)
    return tiles.withColumn("weight", F.when(~mixed, 1.0 / n).when(F.col("positive"), pos_fraction / pos).otherwise((1 - pos_fraction) / (n - pos)))


def convolve_weights(cells: DataFrame, weights: list[list[float]], bias: float = 0.0) -> DataFrame:
    """One odd-sized convolution with zero padding: the stub model, as a join with the weights table."""
    k = len(weights) // 2
    table = cells.sparkSession.createDataFrame([(i - k, j - k, float(w)) for i, line in enumerate(weights) for j, w in enumerate(line)], "dr int, dc int, w double")
    moved = cells.select("row", "col", "value").join(F.broadcast(table)).select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), (F.col("w") * F.col("value")).alias("v"))
    return cells.select("row", "col").join(moved, ["row", "col"]).groupBy("row", "col").agg((F.sum("v") + bias).alias("value"))


def peaks(cells: DataFrame, threshold: float, window: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """row, col, value, sub_row, sub_col of local maxima of non-negative cells, in each raster of keys; places refined by a parabola of logarithms."""
    top = extreme(cells, "value", "top", window // 2, True, keys)
    out = top

    def refined(axis: str, across: str) -> Column:
        line = Window.partitionBy(*keys, across).orderBy(axis)
        before, after = F.lag("value").over(line), F.lead("value").over(line)
        a, b, c = (F.ln(F.greatest(v, F.lit(1e-12))) for v in (before, F.col("value"), after))
        bend = a - 2 * b + c
        inner = before.isNotNull() & after.isNotNull()  # at an edge the cell's centre stays
        return F.when(inner & (bend < 0), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (a - c) / bend))).otherwise(0.0)

    out = out.withColumns({"sub_col": F.col("col") + refined("col", "row"), "sub_row": F.col("row") + refined("row", "col")})
    return out.where((F.col("value") >= F.col("top")) & (F.col("value") >= threshold)).select(*keys, "row", "col", "value", "sub_row", "sub_col")


def close_mask(cells: DataFrame, value: str, rounds: int, grid: Frame = GRID) -> DataFrame:
    """Adds closed: dilation and erosion by 3 x 3, outside counting as false, on dense cells."""
    out = grid.attach(cells.withColumn("closed", F.col(value).cast("int")))
    for _ in range(rounds):
        out = extreme(out, "closed", "closed", 1, True, grid.keys)
    for _ in range(rounds):
        out = extreme(out, "closed", "closed", 1, False, grid.keys)
        edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == grid.height - 1) | (F.col("col") == grid.width - 1)
        out = out.withColumn("closed", F.when(edge, 0).otherwise(F.col("closed")))
    return grid.detach(out)


# -- queries ----------------------------------------------------------------


def _bands(spark, sf_dir):
    pts = with_cells(points(spark, sf_dir)).where("valid")
    return pts.groupBy("row", "col").agg(F.avg("z").alias("red"), (F.avg("intensity") + 1).alias("green"), F.lit(7.0).alias("blue"), F.max("z").alias("nir"))


def q_spectral(spark, sf_dir):
    found, _ = spectral_indices(_bands(spark, sf_dir), None)  # where every cell holds a highest return, nir is constant: its columns are wanted all the same
    return found.select("row", "col", *(F.round(n, 6).alias(n) for n in INDICES))


def q_stretch(spark, sf_dir):
    return stretch(bin_points(points(spark, sf_dir), GRID, "max").select("row", "col", "value"), "value").select("row", "col", "byte")


def _dem(spark, sf_dir):
    """The elevation model; it is kept, as some queries read it twice."""
    return shared.cut(elevation(points(spark, sf_dir)).select("row", "col", F.col("z").alias("value")))


def q_shift(spark, sf_dir):
    dem = _dem(spark, sf_dir)
    return estimate_shift(dem, apply_shift(dem, 2, -3), 4).select("dx", "dy", F.round("confidence", 6).alias("confidence"))


def q_apply_shift(spark, sf_dir):
    return apply_shift(_dem(spark, sf_dir), 2, -3).select("row", "col", F.round("value", 6).alias("value"))


TARGET = Grid(0.25, 0.25, 2.5, 41, 39)


def _resampled(method):
    def run(spark, sf_dir):
        return resample(_dem(spark, sf_dir), GRID, TARGET, method).select("row", "col", F.round("value", 5).alias("value"))

    return run


def q_overlay(spark, sf_dir):
    pts = points(spark, sf_dir)
    fine = bin_points(pts.where("z < 25")).select("row", "col", "value", F.lit(0.5).alias("pixel_size"), F.lit(1).alias("ord"))
    coarse = bin_points(pts, GRID, "max").select("row", "col", "value", F.lit(2.0).alias("pixel_size"), F.lit(0).alias("ord"))
    return overlay(fine.unionByName(coarse)).select("row", "col", F.round("value", 6).alias("value"))


def q_tile_index(spark, sf_dir):
    return tile_index(spark, 100, 105, 32, 8)


def q_tile_positive(spark, sf_dir):
    tiles = tile_cells(_dem(spark, sf_dir), tile_index(spark, 100, 105, 32, 8))
    flags = tiles.groupBy("tile_id").agg((F.max("value") > 49.5).alias("positive"), F.count("*").alias("n"))
    return sample_weights(flags, 0.7).select("tile_id", "positive", "n", F.round("weight", 9).alias("weight"))


def q_stitch(spark, sf_dir):
    parts = tile_cells(_dem(spark, sf_dir), tile_index(spark, 100, 105, 32, 8))
    return stitch(parts.withColumn("value", F.col("value") + F.col("tile_id")), 32).select("row", "col", F.round("value", 5).alias("value"))


STUB = [[0.1, 0.2, 0.1], [0.0, 0.5, 0.0], [-0.1, 0.1, -0.2]]


def q_stub(spark, sf_dir):
    return convolve_weights(_dem(spark, sf_dir), STUB, 0.25).select("row", "col", F.round("value", 6).alias("value"))


def q_peaks(spark, sf_dir):
    return peaks(_dem(spark, sf_dir), 35.0, 7).select("row", "col", F.round("value", 6).alias("value"), F.round("sub_row", 5).alias("sub_row"), F.round("sub_col", 5).alias("sub_col"))


def q_close(spark, sf_dir):
    mask = _dem(spark, sf_dir).withColumn("m", F.col("value") > 24)
    return close_mask(mask, "m", 2).select("row", "col", "closed")


QUERIES = {
    "spectral_indices": q_spectral,
    "stretch_to_byte": q_stretch,
    "estimate_shift": q_shift,
    "apply_shift": q_apply_shift,
    "resample_nearest": _resampled("nearest"),
    "resample_bilinear": _resampled("bilinear"),
    "resample_average": _resampled("average"),
    "overlay_priority": q_overlay,
    "tile_index": q_tile_index,
    "tile_weights": q_tile_positive,
    "stitch_overlap_add": q_stitch,
    "stub_convolution": q_stub,
    "heatmap_peaks": q_peaks,
    "close_valid_mask": q_close,
}

_TILES = "tiles AS (SELECT (row_number() OVER (ORDER BY r, c) - 1)::INT AS tile_id, r AS row0, c AS col0, 32 AS h, 32 AS w FROM unnest([0, 24, 48, 68]) a(r), unnest([0, 24, 48, 72, 73]) b(c))"


def _div(top: str, below: str) -> str:
    return f"CASE WHEN abs({below}) < 1e-6 THEN 0 ELSE ({top}) / ({below}) END"


def _clamp(value: str, low: float, high: float) -> str:
    return f"greatest({low}, least({high}, {value}))"


_FRAC = "(0.25 + (t.{0} + 0.5) * 2.5 - 0.5)::DOUBLE"
_LOG = "ln(greatest({0}, 1e-12::DOUBLE))"


def _sub(axis: str, before: str, after: str) -> str:
    a, b, c = (_LOG.format(v) for v in (before, "z", after))
    return f"{axis} + CASE WHEN {before} IS NULL OR {after} IS NULL THEN 0 WHEN {a} - 2 * {b} + {c} < 0 THEN greatest(-0.5, least(0.5, 0.5 * ({a} - {c}) / ({a} - 2 * {b} + {c}))) ELSE 0 END"


def _morph(name: str, source: str, agg: str, edge: bool) -> str:
    value = f"CASE WHEN a.row IN (0, 99) OR a.col IN (0, 104) THEN 0 ELSE {agg}(b.v) END" if edge else f"{agg}(b.v)"
    return f"{name} AS (SELECT a.row, a.col, {value} AS v FROM {source} a JOIN {source} b ON abs(a.row - b.row) <= 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col)"


ORACLES = {
    "spectral_indices": f"""WITH {POINTS}, b AS (SELECT floor(y)::INT AS row, floor(x)::INT AS col, avg(z) AS r, avg(intensity) + 1 AS g, max(z) AS n FROM pts WHERE {INSIDE} GROUP BY ALL)
      SELECT row, col, round({_clamp(_div('n - r', 'n + r'), -1, 1)}, 6) AS ndvi, round({_clamp(_div('n - g', 'n + g'), -1, 1)}, 6) AS gndvi, round({_clamp(_div('g - n', 'g + n'), -1, 1)}, 6) AS ndwi,
        round({_clamp(_div('n', 'r'), 0, 20)}, 6) AS sr, round({_clamp(_div('1', 'g') + ' - ' + _div('1', 'r'), -10, 10)}, 6) AS ari, round({_clamp(_div('(n - r) * 1.5', 'n + r + 0.5'), -1.5, 1.5)}, 6) AS savi FROM b""",
    "stretch_to_byte": f"""WITH {POINTS}, b AS (SELECT floor(y)::INT AS row, floor(x)::INT AS col, max(z) AS v FROM pts WHERE {INSIDE} GROUP BY ALL),
      p AS (SELECT quantile_cont(v, [0.02, 0.98]) AS q FROM b WHERE v <> 0)
      SELECT row, col, CASE WHEN v = 0 THEN 0 ELSE floor(greatest(0, least(1, (v - q[1]) / CASE WHEN q[2] > q[1] THEN q[2] - q[1] ELSE 1 END)) * 255) END::INT AS byte FROM b, p""",
    "estimate_shift": f"""WITH {DENSE}, b AS (SELECT row - 3 AS row, col + 2 AS col, z FROM dense WHERE row - 3 >= 0 AND col + 2 < 105), j AS (SELECT row, col, a.z AS va, b.z AS vb FROM dense a JOIN b USING (row, col)),
      c AS (SELECT row, col, va - avg(va) OVER () AS ca, vb - avg(vb) OVER () AS cb FROM j), n AS (SELECT sqrt(sum(ca * ca) * sum(cb * cb)) AS nm FROM c),
      lag_ AS (SELECT y.range::INT - 4 AS dy, x.range::INT - 4 AS dx FROM range(9) y, range(9) x),
      s AS (SELECT dx, dy, sum(a.ca * b.cb) AS s FROM c a, lag_ JOIN c b ON b.row = (a.row + dy + 100) % 100 AND b.col = (a.col + dx + 105) % 105 GROUP BY ALL)
      SELECT dx, dy, round(s / nm, 6) AS confidence FROM s, n ORDER BY s DESC LIMIT 1""",
    "apply_shift": f"WITH {DENSE} SELECT g.row, g.col, round(d.z, 6) AS value FROM g LEFT JOIN dense d ON d.row = g.row + 3 AND d.col = g.col - 2",
    "resample_nearest": f"""WITH {DENSE}, t AS (SELECT r.range::INT AS row, c.range::INT AS col FROM range(39) r, range(41) c)
      SELECT t.row, t.col, round(d.z, 5) AS value FROM t LEFT JOIN dense d ON d.row = floor({_FRAC.format('row')} + 0.5) AND d.col = floor({_FRAC.format('col')} + 0.5)""",
    "resample_bilinear": f"""WITH {DENSE}, t AS (SELECT r.range::INT AS row, c.range::INT AS col FROM range(39) r, range(41) c),
      w AS (SELECT t.row, t.col, d.z, (1 - abs({_FRAC.format('row')} - d.row)) * (1 - abs({_FRAC.format('col')} - d.col)) AS w FROM t JOIN dense d
            ON abs({_FRAC.format('row')} - d.row) < 1 AND abs({_FRAC.format('col')} - d.col) < 1)
      SELECT t.row, t.col, round(sum(w * z) / sum(w), 5) AS value FROM t LEFT JOIN w USING (row, col) GROUP BY t.row, t.col""",
    "resample_average": f"""WITH {DENSE}, t AS (SELECT r.range::INT AS row, c.range::INT AS col FROM range(39) r, range(41) c),
      o AS (SELECT t.row, t.col, d.z, least({_FRAC.format('row')} + 1.25, d.row + 0.5) - greatest({_FRAC.format('row')} - 1.25, d.row - 0.5) AS wr,
              least({_FRAC.format('col')} + 1.25, d.col + 0.5) - greatest({_FRAC.format('col')} - 1.25, d.col - 0.5) AS wc
            FROM t JOIN dense d ON abs({_FRAC.format('row')} - d.row) < 1.75 AND abs({_FRAC.format('col')} - d.col) < 1.75)
      SELECT t.row, t.col, round(sum(wr * wc * z) / sum(wr * wc), 5) AS value FROM t LEFT JOIN o ON o.row = t.row AND o.col = t.col AND wr > 1e-9 AND wc > 1e-9 GROUP BY t.row, t.col""",
    "overlay_priority": f"""WITH {POINTS} SELECT floor(y)::INT AS row, floor(x)::INT AS col, round(coalesce(avg(z) FILTER (z < 25), max(z)), 6) AS value FROM pts WHERE {INSIDE} GROUP BY ALL""",
    "tile_index": f"WITH {_TILES} SELECT * FROM tiles",
    "tile_weights": f"""WITH {DENSE}, {_TILES}, f AS (SELECT tile_id, max(z) > 49.5 AS positive, count(*) AS n FROM tiles JOIN dense ON row BETWEEN row0 AND row0 + 31 AND col BETWEEN col0 AND col0 + 31 GROUP BY tile_id)
      SELECT tile_id, positive, n, round(CASE WHEN count(*) FILTER (positive) OVER () IN (0, count(*) OVER ()) THEN 1 / count(*) OVER ()
        WHEN positive THEN 0.7 / count(*) FILTER (positive) OVER () ELSE (1 - 0.7) / count(*) FILTER (NOT positive) OVER () END::DOUBLE, 9) AS weight FROM f""",
    "stitch_overlap_add": f"""WITH {DENSE}, {_TILES}, p AS (
        SELECT row, col, z + tile_id AS v, greatest(sin(pi() * (row - row0 + 0.5) / 32) ** 2, 1e-3) * greatest(sin(pi() * (col - col0 + 0.5) / 32) ** 2, 1e-3) AS w
        FROM tiles JOIN dense ON row BETWEEN row0 AND row0 + 31 AND col BETWEEN col0 AND col0 + 31)
      SELECT row, col, round(sum(w * v) / sum(w), 5) AS value FROM p GROUP BY row, col""",
    "stub_convolution": f"""WITH {DENSE}, k AS (SELECT * FROM (VALUES (-1, -1, 0.1), (-1, 0, 0.2), (-1, 1, 0.1), (0, -1, 0.0), (0, 0, 0.5), (0, 1, 0.0), (1, -1, -0.1), (1, 0, 0.1), (1, 1, -0.2)) t(dr, dc, w))
      SELECT a.row, a.col, round(sum(w::DOUBLE * b.z) + 0.25, 6) AS value FROM dense a, k JOIN dense b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL""",
    "heatmap_peaks": f"""WITH {DENSE}, m AS (SELECT a.row, a.col, max(b.z) AS top FROM dense a JOIN dense b ON b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY ALL),
      n AS (SELECT row, col, z, lag(z) OVER x AS xl, lead(z) OVER x AS xr, lag(z) OVER y AS yl, lead(z) OVER y AS yr FROM dense
            WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))
      SELECT row, col, round(z, 6) AS value, round({_sub('row', 'yl', 'yr')}, 5) AS sub_row, round({_sub('col', 'xl', 'xr')}, 5) AS sub_col FROM n JOIN m USING (row, col) WHERE z >= top AND z >= 35""",
    "close_valid_mask": f"""WITH {DENSE}, s AS (SELECT row, col, (z > 24)::INT AS v FROM dense), {_morph('d1', 's', 'max', False)}, {_morph('d2', 'd1', 'max', False)},
      {_morph('e1', 'd2', 'min', True)}, {_morph('e2', 'e1', 'min', True)} SELECT row, col, v AS closed FROM e2""",
}
