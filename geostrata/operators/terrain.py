"""Elevation models and terrain derivatives over dense cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import nearest_donors
from ..functions.shared import cut
from ..functions.stars import components
from ..functions.window2d import box_mean, box_means, convolve, extreme, gaussian_weights, gradient, laplace, neighbours, second, weighted
from ..model import GRID, Frame
from ..views import DENSE, full_grid, points
from .cells import bin_points, with_cells
from .nearest import k_nearest


#: Radius in cells of the first search for a hole's neighbours: 49 cells.
DISC = 4.0
#: Raster rows that a task of ``fill_nearest`` holds at a time.
ROWS_OF_GROUP = 16


def _donors(holes: DataFrame, known: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """*keys, hrow, hcol, d2, row, col and the known values within radius of each hole."""
    r, square = math.ceil(radius), float(radius) * radius
    near = holes.select(*keys, F.col("row").alias("hrow"), F.col("col").alias("hcol"), F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("dr"))
    half = F.ceil(F.sqrt(F.greatest(F.lit(square) - F.col("dr") * F.col("dr"), F.lit(0.0)))).cast("int")
    near = near.withColumn("dc", F.explode(F.sequence(-half, half)))
    near = near.withColumn("d2", F.col("dr").cast("long") * F.col("dr") + F.col("dc").cast("long") * F.col("dc")).where(F.col("d2") <= square)
    moved = near.select(*keys, "hrow", "hcol", "d2", (F.col("hrow") + F.col("dr")).alias("row"), (F.col("hcol") + F.col("dc")).alias("col"))
    return moved.join(known, [*keys, "row", "col"])


def fill_nearest(cells: DataFrame, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """cells(*keys, row, col, *values), one row for each cell of a raster, with nulls of the first value (and the others there) taken from the nearest cell that has it, however far; ties by row, then column. Without any such cell they stay null. Adds observed.

    Along each column the nearest known cell is found by windows. The donor of a hole then is the donor of one of its
    row's columns, found for whole rows at once in time W log W (see ``functions.distance``). Nothing is exploded or
    joined: every cell is shuffled by its column and by its row.
    """
    k = list(keys)
    held = F.struct(F.col("row").alias("drow"), *values)
    marked = cells.withColumn("__own", F.when(F.col(values[0]).isNotNull(), held))
    seen = lambda order: F.last("__own", ignorenulls=True).over(Window.partitionBy(*k, "col").orderBy(order))
    below, above = seen(F.asc("row")), seen(F.desc("row"))
    marked = marked.withColumns({"__below": below, "__above": above})
    up = F.col("__below").isNull() | (F.col("__above")["drow"] - F.col("row") < F.col("row") - F.col("__below")["drow"])
    marked = marked.withColumn("__donor", F.when(F.coalesce(up, F.lit(False)), F.col("__above")).otherwise(F.col("__below")))
    marked = marked.select(*cells.columns, F.col("__own").isNotNull().alias("observed"), F.col("__donor")["drow"].cast("long").alias("__drow"), *(F.col("__donor")[v].alias(f"__of_{v}") for v in values))
    names = [*cells.columns, "observed"]
    schema = ", ".join(f"`{c}` {dict(marked.dtypes)[c]}" for c in names)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in (*keys, "row", "col")])
        rows, cols = (part.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        drow = part.column("__drow").to_numpy(zero_copy_only=False)
        ends = [np.flatnonzero(rows[1:] != rows[:-1]) + 1]
        for c in keys:
            code = pc.dictionary_encode(part.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy()
            ends.append(np.flatnonzero(code[1:] != code[:-1]) + 1)
        cuts = np.unique(np.concatenate(([0], *ends, [len(rows)])))
        source = np.full(len(rows), -1, np.int64)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            given = np.flatnonzero(~np.isnan(drow[i:j].astype(float)))
            if len(given):
                best = nearest_donors(cols[i:j], rows[i], cols[i:j][given], drow[i:j][given].astype(np.int64))
                source[i:j] = given[best] + i
        take = pa.array(source, mask=source < 0)
        out = {c: part.column(c) for c in names}
        for v in values:
            out[v] = pc.if_else(part.column("observed"), part.column(v), part.column(f"__of_{v}").take(take))
        return pa.table(out)

    return marked.groupBy(*k, F.floor(F.col("row") / ROWS_OF_GROUP).alias("__rows")).applyInArrow(run, schema)


def fill_idw(cells: DataFrame, value: str, max_dist: float | None, k: int = 8, power: float = 2.0, keys: tuple[str, ...] = (), only: str | None = None) -> DataFrame:
    """Nulls (those that the boolean column ``only`` names, if given) become the inverse-distance mean of the k nearest cells with a value, of fewer if there are fewer; ties by row, then column. Adds observed.

    A hole whose nearest cell lies beyond max_dist cells stays null (None: none does). Most holes find k cells within
    ``DISC``; for the others the k nearest come from a pyramid of blocks (see ``nearest.k_nearest``). So a hole meets at most a disc's
    cells and k cells times a constant, however large the gap is.
    """
    whole = [*keys, "row", "col"]
    cells = cut(cells)
    known = cells.where(F.col(value).isNotNull()).select(*whole, F.col(value).alias("__v"))
    holes = cells.where(F.col(value).isNull() & (F.col(only) if only else F.lit(True))).select(*whole)
    weight = 1 / (F.col("d2") if power == 2 else F.pow("d2", F.lit(power / 2)))
    mean = (F.sum(weight * F.col("__v")) / F.sum(weight)).alias("filled")
    place = F.row_number().over(Window.partitionBy(*keys, "hrow", "hcol").orderBy("d2", "row", "col"))
    close = _donors(holes, known, DISC, keys).withColumn("place", place).where(F.col("place") <= k)
    close = close.groupBy(*keys, "hrow", "hcol").agg(mean, F.min("d2").alias("first"), F.count("*").alias("n")).where(F.col("n") >= k)
    close = cut(close.withColumnsRenamed({"hrow": "row", "hcol": "col"}))
    filled = close if max_dist is None else close.where(F.col("first") <= float(max_dist) * max_dist)
    filled, short = filled.select(*whole, "filled"), cut(holes.join(close.select(*whole), whole, "left_anti"))
    if not short.isEmpty():
        filled = filled.unionByName(k_nearest(short, known, k, keys, max_dist).groupBy(*whole).agg(mean))
    joined = cells.join(filled, whole, "left")
    return joined.withColumn("observed", F.col(value).isNotNull()).withColumn(value, F.coalesce(value, "filled")).drop("filled")


def fill_within(cells: DataFrame, value: str, max_dist: float = 7.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nulls from the nearest cell at most max_dist cells away; farther ones stay null. Ties by row, then column. Adds observed."""
    whole = [*keys, "row", "col"]
    known = cells.where(F.col(value).isNotNull()).select(*whole, value)
    near = _donors(cells.where(F.col(value).isNull()), known, max_dist, keys).groupBy(*keys, "hrow", "hcol").agg(F.min_by(value, F.struct("d2", "row", "col")).alias("filled"))
    joined = cells.join(near.withColumnsRenamed({"hrow": "row", "hcol": "col"}), whole, "left")
    return joined.withColumn("observed", F.col(value).isNotNull()).withColumn(value, F.coalesce(value, "filled")).drop("filled")


def build_dtm(pts: DataFrame, grid: Frame = GRID, statistic: str = "mean", max_hole: int = 1000, fill: str = "idw", k: int = 8, power: float = 2.0) -> DataFrame:
    """*keys, row, col, z, n, hole for every cell of the grid, of ground points: holes of at most max_hole cells are filled (idw or nearest), larger ones stay null."""
    if fill not in ("idw", "nearest"):
        raise ValueError(f"unknown fill: {fill}")
    whole = [*grid.keys, "row", "col"]
    binned = bin_points(pts, grid, statistic).withColumnRenamed("value", "z")
    cells = cut(full_grid(pts.sparkSession, grid).join(binned, whole, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("hole", F.col("z").isNull()))
    parts = hole_components(cells.where("hole").select(*whole), grid.keys)
    large = parts.groupBy(*grid.keys, "label").count().where(F.col("count") > max_hole).select(*grid.keys, "label")
    large = parts.join(large, [*grid.keys, "label"], "left_semi").select(*whole, F.lit(True).alias("__large"))
    cells = cut(cells.join(large, whole, "left").withColumn("__small", F.col("hole") & F.col("__large").isNull()).drop("__large"))
    if fill == "idw":
        filled = fill_idw(cells, "z", None, k, power, grid.keys, "__small")
    else:
        filled = fill_nearest(cells, ["z"], grid.keys).withColumn("z", F.when(F.col("hole") & ~F.col("__small"), F.lit(None)).otherwise(F.col("z")))
    return filled.drop("__small", "observed")


def elevation(pts: DataFrame, grid: Frame = GRID) -> DataFrame:
    """row, col, z (mean), low (minimum), observed for every cell of the grid, gaps filled from the nearest cell."""
    cells = with_cells(pts, grid).where("valid").groupBy(*grid.keys, "row", "col").agg(F.avg("z").alias("z"), F.min("z").alias("low"))
    return fill_nearest(full_grid(pts.sparkSession, grid).join(cells, [*grid.keys, "row", "col"], "left"), ["z", "low"], grid.keys)


def slope_aspect(cells: DataFrame, pixel_size: float | Column, value: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds gx, gy, slope (degrees) and aspect (degrees; a flat cell has 180)."""
    g = cells.withColumns({"gx": gradient(value, "x", pixel_size, keys), "gy": gradient(value, "y", pixel_size, keys)})
    aspect = F.pmod(F.degrees(F.atan2(-F.col("gx"), -F.col("gy"))), F.lit(360.0))
    flat = (F.col("gx") == 0) & (F.col("gy") == 0)
    return g.withColumns({"slope": F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))), "aspect": F.when(flat, 180.0).otherwise(aspect)})


def hillshade(azimuth: float, altitude: float = 45.0, z_factor: float = 1.0) -> Column:
    """0 to 255 from gx and gy."""
    gx, gy = F.col("gx") * z_factor, F.col("gy") * z_factor
    slope = F.atan(F.sqrt(gx * gx + gy * gy))
    aspect = F.when((gx == 0) & (gy == 0), F.lit(math.pi)).otherwise(F.atan2(-gx, -gy))
    zenith = math.radians(90 - altitude)
    shade = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(F.lit(math.radians(azimuth)) - aspect)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)) * 255


def slrm(cells: DataFrame, sigma: float, grid: Frame = GRID) -> DataFrame:
    """Adds slrm: elevation above its Gaussian mean."""
    smooth = convolve(grid.attach(cells), "z", "__g", gaussian_weights(sigma), (grid.height, grid.width), keys=grid.keys)
    return grid.detach(smooth.withColumn("slrm", F.col("z") - F.col("__g")).drop("__g"))


def curvature(cells: DataFrame, sigma: float, grid: Frame = GRID) -> DataFrame:
    """Adds curvature: the Laplacian of the Gaussian mean."""
    smooth = convolve(grid.attach(cells), "z", "__g", gaussian_weights(sigma), (grid.height, grid.width), keys=grid.keys)
    return grid.detach(smooth.withColumn("curvature", laplace("__g", grid.keys) / (grid.pixel_size * grid.pixel_size)).drop("__g"))


def tpi_tri(cells: DataFrame, radius: int, grid: Frame = GRID) -> DataFrame:
    """Adds tpi (elevation above its box mean) and tri (deviation in the box)."""
    means = box_means(grid.attach(cells).withColumn("__z2", F.col("z") * F.col("z")), {"__m": "z", "__m2": "__z2"}, radius, (grid.height, grid.width), grid.keys)
    tri = F.sqrt(F.greatest(F.col("__m2") - F.col("__m") * F.col("__m"), F.lit(0.0)))
    return grid.detach(means.withColumns({"tpi": F.col("z") - F.col("__m"), "tri": tri}).drop("__z2", "__m", "__m2"))


def openness(cells: DataFrame, radius: int, directions: int, grid: Frame = GRID) -> DataFrame:
    """*keys, row, col, positive, negative, sky_view: mean extreme angles over directions; offsets wrap around the edges and count nominal distance.

    A raster row is one array and meets each row that the offsets reach once, so an offset is a turned array.
    """
    k, here = list(grid.keys), grid.attach(cells)
    steps = [(d, s, round(s * math.sin(2 * math.pi * d / directions)), round(s * math.cos(2 * math.pi * d / directions))) for d in range(directions) for s in range(1, radius + 1)]
    frame = ["__height", "__pixel_size"] if k else []
    lines = here.groupBy(*k, "row", *frame).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "z"))), lambda c: c["z"]).alias("zs"))
    reach = sorted({r for _, _, r, _ in steps})
    sent = lines.withColumn("d", F.explode(F.array(*map(F.lit, reach))))
    height = grid.height if k else F.lit(grid.height)
    sent = sent.select(*k, F.pmod(F.col("row") - F.col("d"), height).cast("int").alias("row"), "d", "zs")
    around = sent.groupBy(*k, "row").agg(F.map_from_entries(F.collect_list(F.struct("d", "zs"))).alias("near"))
    joined = lines.join(around, [*k, "row"]).withColumn("n", F.size("zs"))
    size = grid.pixel_size if k else F.lit(grid.pixel_size)

    def turned(r: int, c: int) -> Column:
        line = F.element_at("near", F.lit(r))
        at = F.pmod(F.lit(c), F.col("n"))
        return F.concat(F.slice(line, at + 1, F.col("n") - at), F.slice(line, F.lit(1), at))

    def angle(step: int):
        return lambda there, own: F.degrees(F.atan2(there - own, step * size))

    up, down = [], []
    for d in range(directions):
        angles = [F.zip_with(turned(r, c), "zs", angle(s)) for e, s, r, c in steps if e == d]
        both = F.arrays_zip(*(a.alias(f"s{i}") for i, a in enumerate(angles)))
        names = [f"s{i}" for i in range(len(angles))]
        pick = lambda f: F.transform(both, lambda x: f(*(x[n] for n in names)) if len(names) > 1 else x[names[0]])  # noqa: B023, E731
        up.append(pick(F.greatest).alias(f"u{d}"))
        down.append(pick(F.least).alias(f"v{d}"))
    found = joined.select(*k, "row", "zs", *up, *down)
    mean = lambda kind, sign: F.transform(F.sequence(F.lit(1), F.size("zs")), lambda i: sum((90 + sign * F.element_at(f"{kind}{d}", i) for d in range(directions)), F.lit(0.0)) / directions)
    found = found.select(*k, "row", F.posexplode(F.arrays_zip(mean("u", -1).alias("p"), mean("v", 1).alias("q"))).alias("col", "x"))
    found = found.select(*k, "row", "col", F.col("x.p").alias("positive"), F.col("x.q").alias("negative"))
    return found.withColumn("sky_view", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("positive") / 180)))


def progressive_opening(cells: DataFrame, value: str, windows: tuple[int, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds opened: erosions followed by dilations with growing odd windows."""
    out = cells.withColumn("opened", F.col(value))
    for window in windows:
        r = (window + 1 - window % 2) // 2
        out = extreme(extreme(out, "opened", "opened", r, False, keys), "opened", "opened", r, True, keys)
    return out


def artifacts(cells: DataFrame, window: int, threshold: float, grid: Frame = GRID) -> DataFrame:
    """Adds median (of the square window, edge cells repeated) and artifact."""
    r = window // 2
    across = cells.withColumn("__x", neighbours("z", "x", r, grid.width))
    line = Window.partitionBy("col").orderBy("row")
    held = F.collect_list("__x").over(line.rowsBetween(-r, r))
    low, high = F.greatest(F.lit(r) - F.col("row"), F.lit(0)), F.greatest(F.col("row") + r - (grid.height - 1), F.lit(0))
    square = F.flatten(F.concat(F.array_repeat(F.element_at(held, 1), low), held, F.array_repeat(F.element_at(held, -1), high)))
    median = F.element_at(F.array_sort(square), (2 * r + 1) ** 2 // 2 + 1)
    return across.withColumn("median", median).withColumn("artifact", F.abs(F.col("z") - F.col("median")) > threshold).drop("__x")


def hole_components(holes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """holes(*keys, row, col) with label: smallest packed cell number of the 4-connected component. A cell links its run of holes in the row with its run in the column; components of these links are sought until nothing changes."""
    runs = holes.withColumn("label", F.col("row").cast("long") * (1 << 32) + F.col("col"))
    for along, across, first in (("col", "row", "u"), ("row", "col", "v")):
        run = F.col(along) - F.row_number().over(Window.partitionBy(*keys, across).orderBy(along))
        least = F.min("label").over(Window.partitionBy(*keys, across, "__run"))
        runs = runs.withColumn("__run", run).withColumn(first, F.struct(*keys, least.alias("label"))).drop("__run")
    runs = cut(runs.drop("label"))
    found = components(runs.select("u", "v").distinct()).select(F.col("node").alias("u"), F.col("component.label").alias("label"))
    return runs.join(found, "u", "left").withColumn("label", F.coalesce("label", "u.label")).select(*holes.columns, "label")


@dataclass(frozen=True)
class Relief:
    """Which relief layers: their radii (cells), sigmas (cells) and azimuths (degrees)."""

    azimuths: tuple[float, ...] = (45, 135, 225, 315)
    altitude: float = 45.0
    z_factor: float = 1.0
    slrm: tuple[float, ...] = (2, 8, 32)
    openness: tuple[int, int] = (10, 16)
    curvature: tuple[float, ...] = (2, 8)
    tpi: tuple[int, ...] = (5, 15)
    tri: tuple[int, ...] = (3, 9)

    def names(self) -> list[str]:
        tag = lambda word, sizes: [f"{word}_{size:g}".replace(".", "_") for size in sizes]
        return ["slope", "aspect_sin", "aspect_cos", *tag("hillshade_az", self.azimuths), *tag("slrm_sigma", self.slrm), "positive_openness", "negative_openness", "sky_view_factor",
                *tag("curvature_sigma", self.curvature), *tag("tpi_radius", self.tpi), *tag("tri_radius", self.tri)]


def relief_layers(cells: DataFrame, grid: Frame = GRID, relief: Relief = Relief()) -> DataFrame:
    """*keys, row, col and the layers ``relief.names()`` of cells(*keys, row, col, z) that cover the grid. Null cells take the nearest height for their neighbours' sake and get null layers.

    All windows along rows come first, then all along columns, then the rows' part of the curvature: three shuffles for any number of layers.
    """
    k = grid.keys
    filled = cut(fill_nearest(cells.select(*k, "row", "col", "z"), ["z"], k))
    here = grid.attach(filled).withColumn("__z2", F.col("z") * F.col("z"))
    sigmas = sorted({*relief.slrm, *relief.curvature})
    radii = sorted({*relief.tpi, *relief.tri})
    for axis, size in (("x", grid.width), ("y", grid.height)):
        first = axis == "x"
        here = here.withColumns(
            {f"g{axis}": gradient("z", axis, grid.pixel_size, k)}
            | {f"__g{i}": weighted("z" if first else f"__g{i}", axis, gaussian_weights(s), size, keys=k) for i, s in enumerate(sigmas)}
            | {f"__m{r}": box_mean("z" if first else f"__m{r}", axis, r, size, k) for r in radii}
            | {f"__q{r}": box_mean("__z2" if first else f"__q{r}", axis, r, size, k) for r in radii if r in relief.tri}
        )
    curved = [i for i, s in enumerate(sigmas) if s in relief.curvature]
    for axis in ("y", "x"):
        here = here.withColumns({f"__{axis}{i}": second(f"__g{i}", axis, k) for i in curved})
    gx, gy = F.col("gx"), F.col("gy")
    flat = (gx == 0) & (gy == 0)
    aspect = F.when(flat, F.lit(math.pi)).otherwise(F.atan2(-gx, -gy))
    layers = [F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))), F.sin(aspect), F.cos(aspect)]
    layers += [hillshade(a, relief.altitude, relief.z_factor) for a in relief.azimuths]
    layers += [F.col("z") - F.col(f"__g{sigmas.index(s)}") for s in relief.slrm]
    layers += [F.col("positive"), F.col("negative"), F.col("sky_view")]
    layers += [(F.col(f"__x{i}") + F.col(f"__y{i}")) / (grid.pixel_size * grid.pixel_size) for i in (sigmas.index(s) for s in relief.curvature)]
    layers += [F.col("z") - F.col(f"__m{r}") for r in relief.tpi]
    layers += [F.sqrt(F.greatest(F.col(f"__q{r}") - F.col(f"__m{r}") * F.col(f"__m{r}"), F.lit(0.0))) for r in relief.tri]
    open_ = openness(filled.select(*k, "row", "col", "z"), *relief.openness, grid)
    joined = here.join(open_, [*k, "row", "col"])
    return joined.select(*k, "row", "col", *(F.when(F.col("observed"), layer).alias(name) for name, layer in zip(relief.names(), layers, strict=True)))


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _dem(spark, sf_dir):
    return elevation(points(spark, sf_dir))


def q_elevation(spark, sf_dir):
    return _dem(spark, sf_dir).select("row", "col", *_r("z", "low"), "observed")


def q_slope_aspect(spark, sf_dir):
    return slope_aspect(_dem(spark, sf_dir), 1.0).select("row", "col", *_r("slope", "aspect"))


def q_hillshade(spark, sf_dir):
    g = slope_aspect(_dem(spark, sf_dir), 1.0)
    return g.select("row", "col", *(F.round(hillshade(a), 5).alias(f"shade_{a}") for a in (45, 135, 225, 315)))


def q_slrm(spark, sf_dir):
    return slrm(_dem(spark, sf_dir), 2.0).select("row", "col", *_r("slrm"))


def q_curvature(spark, sf_dir):
    return curvature(_dem(spark, sf_dir), 2.0).select("row", "col", *_r("curvature"))


def q_tpi_tri(spark, sf_dir):
    return tpi_tri(_dem(spark, sf_dir), 3).select("row", "col", F.round("tpi", 6).alias("tpi"), F.round("tri", 5).alias("tri"))


def q_openness(spark, sf_dir):
    return openness(_dem(spark, sf_dir), 5, 8).select("row", "col", *_r("positive", "negative", "sky_view"))


def q_opening(spark, sf_dir):
    return progressive_opening(_dem(spark, sf_dir), "low", (3, 5)).select("row", "col", "low", "opened")


def q_artifacts(spark, sf_dir):
    return artifacts(_dem(spark, sf_dir), 3, 5.0).select("row", "col", *_r("median"), "artifact")


def _gappy(spark, sf_dir):
    """Mean elevation where a cell has points whose row and column aren't both multiples of 7; the rest are gaps."""
    cells = bin_points(points(spark, sf_dir)).where("not (row % 7 = 0 and col % 7 = 0)").select("row", "col", F.col("value").alias("z"))
    return full_grid(spark).join(cells, ["row", "col"], "left")


def q_idw(spark, sf_dir):
    return fill_idw(_gappy(spark, sf_dir), "z", 4.0).select("row", "col", *_r("z"), "observed")


def q_within(spark, sf_dir):
    sparse = bin_points(points(spark, sf_dir)).where("row % 9 = 0 and col % 9 = 0").select("row", "col", F.col("value").alias("z"))
    return fill_within(full_grid(spark).join(sparse, ["row", "col"], "left"), "z", 5.0).select("row", "col", *_r("z"), "observed")


def q_holes(spark, sf_dir):
    labels = hole_components(_gappy(spark, sf_dir).where("z is null").select("row", "col"))
    return labels.groupBy("label").agg(F.count("*").alias("size"), F.min("row").alias("row0"), F.max("col").alias("col1"))


QUERIES = {
    "elevation_fill_nearest": q_elevation,
    "slope_aspect": q_slope_aspect,
    "hillshade": q_hillshade,
    "slrm": q_slrm,
    "curvature": q_curvature,
    "tpi_tri": q_tpi_tri,
    "openness": q_openness,
    "progressive_opening": q_opening,
    "dtm_artifacts": q_artifacts,
    "fill_idw": q_idw,
    "fill_within": q_within,
    "hole_components": q_holes,
}

_G = f"""{DENSE}, e AS (
  SELECT *, lag(z) OVER x AS xl, lead(z) OVER x AS xr, lag(z) OVER y AS yl, lead(z) OVER y AS yr FROM dense
  WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)
), gr AS (
  SELECT row, col, CASE WHEN xl IS NULL THEN xr - z WHEN xr IS NULL THEN z - xl ELSE (xr - xl) / 2 END AS gx,
         CASE WHEN yl IS NULL THEN yr - z WHEN yr IS NULL THEN z - yl ELSE (yr - yl) / 2 END AS gy FROM e
)"""


def _blur(name: str, source: str, value: str, weights: str) -> str:
    """A separable filter by self-joins on clamped offsets; weights(k, w)."""
    return f"""{name}_x AS (
  SELECT a.row, a.col, sum(w.w * b.v) AS v FROM (SELECT row, col FROM {source}) a, {weights} w
  JOIN (SELECT row, col, {value} AS v FROM {source}) b ON b.row = a.row AND b.col = greatest(0, least(104, a.col + w.k)) GROUP BY ALL
), {name} AS (
  SELECT a.row, a.col, sum(w.w * b.v) AS v FROM (SELECT row, col FROM {source}) a, {weights} w
  JOIN {name}_x b ON b.col = a.col AND b.row = greatest(0, least(99, a.row + w.k)) GROUP BY ALL
)"""


_GAUSS = "wg AS (SELECT k, exp(-0.5 * (k / 2.0::DOUBLE) ** 2) / (sum(exp(-0.5 * (k / 2.0::DOUBLE) ** 2)) OVER ()) AS w FROM (SELECT range::INT - 8 AS k FROM range(17)))"
_BOX = "wb AS (SELECT range::INT - 3 AS k, 1 / 7::DOUBLE AS w FROM range(7))"
_SHADE = "round(greatest(0, least(1, cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians({0}) - a))) * 255, 5) AS shade_{0}"
_GAPPY = f"{DENSE}, gappy AS (SELECT row, col, CASE WHEN row % 7 = 0 AND col % 7 = 0 THEN NULL ELSE v END AS z FROM raw)"


def _idw(name: str, source: str, hole: str, limit: float | None) -> str:
    """row, col, f: the inverse-distance mean of the eight nearest cells of source that have z, for its cells that are holes."""
    d2 = "((d.row - h.row) * (d.row - h.row) + (d.col - h.col) * (d.col - h.col))"
    near = f"SELECT h.row, h.col, arg_min({{'z': d.z, 'd2': {d2}}}, {d2}::BIGINT * 1000000 + d.row * 1000 + d.col, 8) AS ds FROM (SELECT * FROM {source} WHERE {hole}) h, (SELECT * FROM {source} WHERE z IS NOT NULL) d GROUP BY ALL"
    within = f"WHERE ds[1].d2 <= {limit * limit}" if limit else ""
    return f"{name} AS (SELECT row, col, list_sum(list_transform(ds, lambda d: d.z / d.d2::DOUBLE)) / list_sum(list_transform(ds, lambda d: 1 / d.d2::DOUBLE)) AS f FROM ({near}) {within})"


def _square(agg: str, source: str, r: int) -> str:
    return f"""SELECT a.row, a.col, {agg}(b.v) AS v FROM {source} a JOIN {source} b
  ON b.row BETWEEN a.row - {r} AND a.row + {r} AND b.col BETWEEN a.col - {r} AND a.col + {r} GROUP BY ALL"""


ORACLES = {
    "elevation_fill_nearest": f"WITH {DENSE} SELECT row, col, round(z, 6) AS z, round(low, 6) AS low, observed FROM dense",
    "slope_aspect": f"""WITH {_G} SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope,
        round(CASE WHEN gx = 0 AND gy = 0 THEN 180 ELSE (degrees(atan2(-gx, -gy)) + 360) % 360 END, 6) AS aspect FROM gr""",
    "hillshade": f"""WITH {_G}, sa AS (SELECT row, col, atan(sqrt(gx * gx + gy * gy)) AS s, CASE WHEN gx = 0 AND gy = 0 THEN pi() ELSE atan2(-gx, -gy) END AS a FROM gr)
        SELECT row, col, {", ".join(_SHADE.format(a) for a in (45, 135, 225, 315))} FROM sa""",
    "slrm": f"WITH {DENSE}, {_GAUSS}, {_blur('sm', 'dense', 'z', 'wg')} SELECT row, col, round(z - v, 6) AS slrm FROM dense JOIN sm USING (row, col)",
    "curvature": f"""WITH {DENSE}, {_GAUSS}, {_blur('sm', 'dense', 'z', 'wg')}, l AS (
        SELECT row, col, coalesce(lag(v) OVER x, v) + coalesce(lead(v) OVER x, v) + coalesce(lag(v) OVER y, v) + coalesce(lead(v) OVER y, v) - 4 * v AS c FROM sm
        WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))
      SELECT row, col, round(c, 6) AS curvature FROM l""",
    "tpi_tri": f"""WITH {DENSE}, {_BOX}, {_blur('m1', 'dense', 'z', 'wb')}, {_blur('m2', 'dense', 'z * z', 'wb')}
      SELECT row, col, round(z - m1.v, 6) AS tpi, round(sqrt(greatest(m2.v - m1.v * m1.v, 0)), 5) AS tri FROM dense JOIN m1 USING (row, col) JOIN m2 USING (row, col)""",
    "openness": f"""WITH {DENSE}, o AS (
        SELECT d.range AS dir, round_even(s.range * sin(2 * pi() * d.range / 8), 0)::INT AS dr, round_even(s.range * cos(2 * pi() * d.range / 8), 0)::INT AS dc, s.range::DOUBLE AS dist FROM range(8) d, range(1, 6) s
      ), m AS (
        SELECT a.row, a.col, dir, max(degrees(atan2(b.z - a.z, dist))) AS up, min(degrees(atan2(b.z - a.z, dist))) AS down
        FROM dense a, o JOIN dense b ON b.row = (a.row + dr + 100) % 100 AND b.col = (a.col + dc + 105) % 105 GROUP BY ALL
      ), f AS (SELECT row, col, avg(90 - up) AS p, avg(90 + down) AS n FROM m GROUP BY ALL)
      SELECT row, col, round(p, 6) AS positive, round(n, 6) AS negative, round(greatest(0, least(1, p / 180)), 6) AS sky_view FROM f""",
    "progressive_opening": f"""WITH {DENSE}, s0 AS (SELECT row, col, low AS v FROM dense), e1 AS ({_square('min', 's0', 1)}), d1 AS ({_square('max', 'e1', 1)}),
      e2 AS ({_square('min', 'd1', 2)}), d2 AS ({_square('max', 'e2', 2)}) SELECT row, col, low, d2.v AS opened FROM dense JOIN d2 USING (row, col)""",
    "dtm_artifacts": f"""WITH {DENSE}, o AS (SELECT r.range::INT - 1 AS dr, c.range::INT - 1 AS dc FROM range(3) r, range(3) c), m AS (
        SELECT a.row, a.col, a.z, median(b.z) AS md FROM dense a, o JOIN dense b ON b.row = greatest(0, least(99, a.row + dr)) AND b.col = greatest(0, least(104, a.col + dc)) GROUP BY ALL)
      SELECT row, col, round(md, 6) AS median, abs(z - md) > 5 AS artifact FROM m""",
    "fill_idw": f"""WITH {_GAPPY}, {_idw("i", "gappy", "z IS NULL", 4)}
      SELECT gappy.row, gappy.col, round(coalesce(z, f), 6) AS z, z IS NOT NULL AS observed FROM gappy LEFT JOIN i ON i.row = gappy.row AND i.col = gappy.col""",
    "fill_within": f"""WITH {DENSE}, s AS (SELECT row, col, CASE WHEN row % 9 = 0 AND col % 9 = 0 THEN v END AS z FROM raw),
      n AS (SELECT h.row, h.col, min_by(d.z, ((d.row - h.row) ** 2 + (d.col - h.col) ** 2)::BIGINT * 1000000 + d.row * 1000 + d.col) AS f FROM s h JOIN s d ON h.z IS NULL AND d.z IS NOT NULL AND (d.row - h.row) ** 2 + (d.col - h.col) ** 2 <= 25 GROUP BY ALL)
      SELECT s.row, s.col, round(coalesce(z, f), 6) AS z, z IS NOT NULL AS observed FROM s LEFT JOIN n USING (row, col)""",
    "hole_components": f"""WITH RECURSIVE {_GAPPY}, h AS (SELECT row, col, row::BIGINT * 4294967296 + col AS id FROM gappy WHERE z IS NULL),
      adj AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
      reach(id, seen) AS (SELECT id, id FROM h UNION SELECT adj.b, reach.seen FROM reach JOIN adj ON adj.a = reach.id AND reach.seen < adj.b),
      lab AS (SELECT id, min(seen) AS label FROM reach GROUP BY id)
      SELECT label, count(*) AS size, min(row) AS row0, max(col) AS col1 FROM lab JOIN h USING (id) GROUP BY label""",
}
