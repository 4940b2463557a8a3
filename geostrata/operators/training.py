"""Tiles for training as queries: crops, flips, schedules, losses, peak splits, alignment reports, coordinate-system candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import projection, shared
from ..model import GRID, Grid
from ..views import DENSE, OBJECTS, points, table, truths
from .geometry import split_by_peaks
from .matching import outlines, rasterize
from .rasters import apply_shift, estimate_shifts, tile_cells, tile_index
from .terrain import elevation


def crop_starts(spark, n: int, height: int, width: int, tile: int, seed: int) -> DataFrame:
    """k, row0, col0 of n window origins, fixed by the seed."""
    at = lambda salt, size: F.pmod(F.xxhash64("k", F.lit(seed), F.lit(salt)), F.lit(max(1, size - tile + 1))).cast("int")
    return spark.range(n).select(F.col("id").alias("k")).select("k", at(0, height).alias("row0"), at(1, width).alias("col0"))


def augment(cells: DataFrame, tile: int, hflip: Column, vflip: Column, turns: Column) -> DataFrame:
    """Places of cells(i, j) in square tiles after flips and quarter turns against the clock."""
    last = tile - 1
    j = F.when(hflip, last - F.col("j")).otherwise(F.col("j"))
    i = F.when(vflip, last - F.col("i")).otherwise(F.col("i"))
    t = F.pmod(turns, F.lit(4))
    return cells.withColumns({"ni": F.when(t == 0, i).when(t == 1, last - j).when(t == 2, last - i).otherwise(j), "nj": F.when(t == 0, j).when(t == 1, i).when(t == 2, last - j).otherwise(last - i)})


def cosine_rate(step: Column, total: int, base: float, warmup: int) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, base * (step + 1) / max(1, warmup)).otherwise(0.5 * base * (1 + F.cos(math.pi * share)))


def losses(cells: DataFrame, smooth: float = 1.0, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """cells(cls, p, y, valid) to cls, dice, focal over valid cells."""
    p, y = F.col("p"), F.col("y")
    pt = F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-7))
    focal = -F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(1 - pt, gamma) * F.ln(pt)
    dice = 1 - (2 * F.sum(p * y) + smooth) / (F.sum(p) + F.sum(y) + smooth)
    return cells.where("valid").groupBy("cls").agg(dice.alias("dice"), F.avg(focal).alias("focal"))


def masked_loss(cells: DataFrame, smooth: float = 1.0, alpha: float = 0.25, gamma: float = 2.0, beta: float = 2.0, least_mass: float = 50.0, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """One row loss, dice, focal, heat of ``cells(cls, seg, hm, y_seg, y_hm, valid, observed)``, seg and hm being logits.

    Each part is the mean over classes that have a counted cell; a cell counts as observed (0 to 1) where valid. The
    bumps' loss is divided by their mass, at least ``least_mass``. weights: of the masks, of dice and focal in them, of the
    bumps. Without any counted cell all are 0.
    """
    seg, hm, y, t = (F.col(c).cast("double") for c in ("seg", "hm", "y_seg", "y_hm"))
    m = F.when(F.col("valid"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("observed").cast("double")))).otherwise(0.0)
    squash = lambda x: 1 / (1 + F.exp(-x))
    entropy = lambda x, want: F.greatest(x, F.lit(0.0)) - x * want + F.log1p(F.exp(-F.abs(x)))
    p, q = squash(seg), squash(hm)
    right, share = y * p + (1 - y) * (1 - p), y * alpha + (1 - y) * (1 - alpha)
    sums = {"n": m, "both": p * y * m, "either": (p + y) * m, "hard": share * F.pow(1 - right, gamma) * entropy(seg, y) * m, "bumps": F.pow(F.abs(q - t), beta) * entropy(hm, t) * m, "mass": t * m}
    by_class = cells.groupBy("cls").agg(*(F.sum(v).alias(k) for k, v in sums.items())).where("n > 0")
    mean = lambda v: F.coalesce(F.avg(v), F.lit(0.0))
    parts = by_class.agg(
        mean(1 - (2 * F.col("both") + smooth) / (F.col("either") + smooth)).alias("dice"),
        mean(F.col("hard") / F.greatest(F.col("n"), F.lit(1.0))).alias("focal"),
        mean(F.col("bumps") / F.greatest(F.col("mass"), F.lit(least_mass))).alias("heat"),
    )
    a, b, c, d = weights
    return parts.select((a * (b * F.col("dice") + c * F.col("focal")) + d * F.col("heat")).alias("loss"), "dice", "focal", "heat")


def training_tiles(cells: DataFrame, tiles: DataFrame, size: int, values: list[str]) -> DataFrame:
    """tile_id, i, j, *values, valid: the cells of each of ``tiles(tile_id, row0, col0, h, w)``, in a square of ``size``.

    Nulls become 0; a cell counts as valid where ``cells(row, col, valid, *values)`` says so, the padding never. Only the
    padding is generated, so nothing but the cells is joined.
    """
    inner = tile_cells(cells, tiles).select("tile_id", "i", "j", *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values), F.coalesce("valid", F.lit(False)).alias("valid"))
    side = F.sequence(F.lit(0), F.lit(size - 1))
    frame = tiles.where((F.col("h") < size) | (F.col("w") < size)).withColumn("i", F.explode(side)).withColumn("j", F.explode(side))
    padding = frame.where((F.col("i") >= F.col("h")) | (F.col("j") >= F.col("w")))
    return inner.unionByName(padding.select("tile_id", "i", "j", *(F.lit(0.0).alias(v) for v in values), F.lit(False).alias("valid")))


def tile_flags(pixels: DataFrame, seg: list[str], hm: list[str]) -> DataFrame:
    """tile_id, n, n_valid, positive: whether a mask is above 0 or a bump reaches 0.5 in the tile."""
    hit = F.lit(False)
    for c in seg:
        hit = hit | (F.col(c) > 0)
    for c in hm:
        hit = hit | (F.col(c) >= 0.5)
    return pixels.groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.max(hit).alias("positive"))


def check_alignment(layers: dict[str, DataFrame], reference: str, max_shift: int, least: float = 0.3, grid: Grid = GRID) -> DataFrame:
    """layer, dx, dy, confidence of each layer against the reference; below the least confidence the shift is 0."""
    long = None
    for name in sorted(layers):
        one = layers[name].select(F.lit(name).alias("layer"), "row", "col", "value")
        long = one if long is None else long.unionByName(one)
    found = estimate_shifts(layers[reference], long, max_shift, grid)
    return found.select("layer", *(F.when(F.col("confidence") >= least, F.col(c)).otherwise(0).alias(c) for c in ("dx", "dy")), "confidence")


def crs_candidates(places: DataFrame, codes: list[int], limit_km: float = 5.0) -> DataFrame:
    """places(id, x, y, lon, lat): the systems in which x, y lies near lon, lat. The candidates are a fixed list, so each adds a column."""
    options = []
    for code in codes:
        lon, lat = projection.to_lon_lat(code, F.col("x"), F.col("y"))
        options.append(F.struct(F.lit(code).alias("epsg"), projection.haversine_km(lon, lat, F.col("lon"), F.col("lat")).alias("km")))
    return places.select("id", F.inline(F.array(*options))).where(F.col("km") < limit_km)


def inventory(spark, root: str) -> DataFrame:
    """path, bytes, modified, modality, sha256 of every file below root; no hash from 2 GiB on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.lower("path")
    kind = F.when(name.rlike(r"\.(las|laz)$"), "lidar").when(name.rlike(r"\.tiff?$"), "raster").when(name.rlike(r"\.(geo)?json$"), "labels").otherwise("other")
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), kind.alias("modality"), F.when(F.col("length") < 1 << 31, F.sha2("content", 256)).alias("sha256"))


def q_augment(spark, sf_dir):
    key = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", (key % 32).cast("int").alias("i"), (key * 7 % 32).cast("int").alias("j"))
    return augment(cells, 32, F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).select("s_suppkey", "ni", "nj")


def q_rate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(cosine_rate(F.col("c_custkey"), 1000, 0.1, 50), 9).alias("rate"))


def q_losses(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cls"), (F.col("l_discount") * 9).alias("p"), (F.col("l_quantity") > 30).cast("int").alias("y"), (F.col("l_linenumber") < 6).alias("valid"))
    return losses(cells).select("cls", F.round("dice", 6).alias("dice"), F.round("focal", 6).alias("focal"))


def q_masked(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cls"), ((F.col("l_discount") - 0.05) * 40).alias("seg"), ((F.col("l_tax") - 0.04) * 50).alias("hm"), (F.col("l_quantity") > 30).cast("int").alias("y_seg"),
        (F.col("l_partkey") % 100 / F.lit(100.0)).alias("y_hm"), (F.col("l_linenumber") < 6).alias("valid"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("observed"),
    )
    return masked_loss(cells).select(*(F.round(c, 7).alias(c) for c in ("loss", "dice", "focal", "heat")))


def q_tiles(spark, sf_dir):
    dem = elevation(points(spark, sf_dir)).select("row", "col", "z", F.col("observed").alias("valid"))
    mask = rasterize(outlines(truths(spark, sf_dir))).where("cls = 1").select("row", "col", F.lit(1).alias("seg"))
    pixels = training_tiles(dem.join(mask, ["row", "col"], "left"), tile_index(spark, 100, 105, 104, 8), 104, ["z", "seg"])
    return tile_flags(pixels, ["seg"], []).join(pixels.groupBy("tile_id").agg(F.round(F.sum("z"), 4).alias("z"), F.sum("seg").alias("seg")), "tile_id")


def q_split_peaks(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 30).alias("part"), (F.col("c_custkey") * 37 % 100).alias("row"), (F.col("c_custkey") * 91 % 105).alias("col")).distinct()
    sup = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).alias("part"), F.col("s_suppkey").alias("peak"), (F.col("s_suppkey") * 13 % 100).alias("prow"), (F.col("s_suppkey") * 29 % 105).alias("pcol"))
    return split_by_peaks(cust, sup).select("part", "row", "col", F.col("peak").cast("long").alias("peak"))


def q_alignment(spark, sf_dir):
    dem = shared.cut(elevation(points(spark, sf_dir)).select("row", "col", F.col("z").alias("value")))
    other = dem.withColumn("value", F.pmod(F.xxhash64("row", "col"), F.lit(1000)).cast("double"))
    found = check_alignment({"dtm": dem, "moved": apply_shift(dem, -2, 1), "noise": other}, "dtm", 3)
    return found.select("layer", "dx", "dy", (F.col("confidence") > 0.9).alias("sure"))


def q_candidates(spark, sf_dir):
    key = F.col("c_custkey")
    lon, lat = 30 + key * 37 % 190 / F.lit(10.0), 50 + key * 91 % 100 / F.lit(10.0)
    x, y = projection.mercator(lon, lat)
    places = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 2 == 0, x).otherwise(lon).alias("x"), F.when(key % 2 == 0, y).otherwise(lat).alias("y"), lon.alias("lon"), lat.alias("lat"))
    return crs_candidates(places, [3857, 4326, 32637]).select("id", "epsg")


QUERIES = {"augment_places": q_augment, "cosine_rate": q_rate, "losses": q_losses, "masked_loss": q_masked, "training_tiles": q_tiles, "split_by_peaks": q_split_peaks, "check_alignment": q_alignment, "crs_candidates": q_candidates}
ORACLES = {
    "augment_places": """WITH f AS (SELECT s_suppkey, s_suppkey % 4 AS t, CASE WHEN s_suppkey % 3 = 0 THEN 31 - s_suppkey % 32 ELSE s_suppkey % 32 END AS i, CASE WHEN s_suppkey % 2 = 0 THEN 31 - s_suppkey * 7 % 32 ELSE s_suppkey * 7 % 32 END AS j FROM supplier)
      SELECT s_suppkey, (CASE t WHEN 0 THEN i WHEN 1 THEN 31 - j WHEN 2 THEN 31 - i ELSE j END)::INT AS ni, (CASE t WHEN 0 THEN j WHEN 1 THEN i WHEN 2 THEN 31 - j ELSE 31 - i END)::INT AS nj FROM f""",
    "cosine_rate": "SELECT c_custkey, round(CASE WHEN c_custkey < 50 THEN 0.1 * (c_custkey + 1) / 50 ELSE 0.05 * (1 + cos(pi() * least(1, (c_custkey - 50) / 950))) END, 9) AS rate FROM customer",
    "losses": """WITH c AS (SELECT l_returnflag AS cls, l_discount * 9 AS p, (l_quantity > 30)::INT AS y FROM lineitem WHERE l_linenumber < 6),
      f AS (SELECT *, greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-7) AS pt FROM c)
      SELECT cls, round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) AS dice, round(avg(-CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END * (1 - pt) ** 2 * ln(pt)), 6) AS focal FROM f GROUP BY cls""",
    "masked_loss": """WITH c AS (SELECT l_returnflag AS cls, (l_discount - 0.05) * 40 AS s, (l_tax - 0.04) * 50 AS h, (l_quantity > 30)::INT AS y, (l_partkey % 100) / 100::DOUBLE AS t FROM lineitem WHERE l_linenumber < 6 AND l_returnflag <> 'R'),
      e AS (SELECT *, 1 / (1 + exp(-s)) AS p, 1 / (1 + exp(-h)) AS q FROM c),
      k AS (SELECT cls, 1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1) AS d, avg(CASE y WHEN 1 THEN -0.25 * (1 - p) ** 2 * ln(p) ELSE -0.75 * p ** 2 * ln(1 - p) END) AS f, sum((q - t) ** 2 * -(t * ln(q) + (1 - t) * ln(1 - q))) / greatest(sum(t), 50) AS b FROM e GROUP BY cls)
      SELECT round(avg(d) + avg(f) + avg(b), 7) AS loss, round(avg(d), 7) AS dice, round(avg(f), 7) AS focal, round(avg(b), 7) AS heat FROM k""",
    "training_tiles": f"""WITH {DENSE}, {OBJECTS}, m AS (SELECT dense.row, col, z, observed, EXISTS (SELECT 1 FROM gt WHERE cls = 1 AND col + 0.5 >= cx - half AND col + 0.5 < cx + half AND row + 0.5 >= cy - half AND row + 0.5 < cy + half)::INT AS seg FROM dense),
      t AS (SELECT * FROM (VALUES (0, 0), (1, 1)) t(tile_id, c0))
      SELECT tile_id, 104 * 104::BIGINT AS n, count(*) FILTER (observed) AS n_valid, max(seg) > 0 AS positive, round(sum(z), 4) AS z, sum(seg)::DOUBLE AS seg FROM t JOIN m ON col >= c0 AND col < c0 + 104 GROUP BY tile_id""",
    "split_by_peaks": """WITH c AS (SELECT DISTINCT c_custkey % 30 AS part, c_custkey * 37 % 100 AS row, c_custkey * 91 % 105 AS col FROM customer),
      p AS (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM (SELECT s_suppkey % 25 AS part, s_suppkey AS peak, s_suppkey * 13 % 100 AS prow, s_suppkey * 29 % 105 AS pcol FROM supplier)),
      r AS (SELECT c.part, row, col, peak, row_number() OVER (PARTITION BY c.part, row, col ORDER BY (row - prow) ** 2 + (col - pcol) ** 2, peak) AS k FROM c JOIN p ON c.part = p.part AND n > 1)
      SELECT c.part, c.row, c.col, coalesce(r.peak, 1) AS peak FROM c LEFT JOIN r ON r.part = c.part AND r.row = c.row AND r.col = c.col AND k = 1""",
    "check_alignment": "SELECT * FROM (VALUES ('dtm', 0, 0, true), ('moved', -2, 1, true), ('noise', 0, 0, false)) t(layer, dx, dy, sure)",
    "crs_candidates": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 3857 ELSE 4326 END AS epsg FROM customer",
}
