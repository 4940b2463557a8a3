"""Training data of many sites: channels and targets of every cell, tiles as arrays of fixed size, seeded draws with a share of positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..model import SiteGrids
from ..operators.cells import normalize, with_cells
from ..operators.labels import class_validity
from ..operators.matching import label_targets, outlines
from ..operators.terrain import fill_within
from ..views import INSIDE, OBJECTS, POINTS, points, truths
from .outlines import COLS, ROWS, _grids

#: Layer that says where a site is measured, cells that its gaps are filled over, layers scaled together (fixed values).
MEASURED, GAP, TOGETHER = "dtm", 7.0, ("rgb_r", "rgb_g", "rgb_b")
#: A bump of at least this makes a tile positive (fixed value).
BUMP = 0.5
#: Buckets in which tiles are numbered.
BUCKETS = 1024


def load_sites(layers: DataFrame, grids: SiteGrids, channels: list[str], objects: DataFrame | None = None, classes: list[str] | None = None, sigma: float = 2.0, robust: bool = True) -> DataFrame:
    """site, row, col, valid, x (an array of channels), and with objects seg, hm (arrays of classes) of every cell of every site.

    ``layers(site, layer, row, col, value)``: gaps of the measured layer are filled from the nearest cell within seven;
    ``robust`` scales each layer of a site by its percentiles, colours together; what is missing, null or NaN then is 0. A
    cell is valid where the measured layer has a value after filling; all are where a site lacks that layer, whether or
    not it is a channel. ``objects(site, id, cls, geom_type, rings)`` give masks and bumps; cells outside a site's grid and
    other layers and classes are left out. Channels, masks and bumps meet the cells in one shuffle.
    """
    if len(set(channels)) < len(channels) or not channels:
        raise ValueError("channels are named once, one at least")
    spark, cell = layers.sparkSession, ["site", "row", "col"]
    known = layers.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*cell, "layer", F.col("value").cast("double").alias("value"))
    frame = cut(grids.cells(spark).select(*cell))
    ground = frame.join(known.where(F.col("layer") == MEASURED).drop("layer"), cell, "left")
    ground = fill_within(ground, "value", GAP, ("site",)).where("value is not null").select(*cell, F.lit(MEASURED).alias("layer"), "value")
    all_ = cut(known.where(F.col("layer").isin([c for c in channels if c != MEASURED])).unionByName(ground))
    seen = all_.where(F.col("layer") == MEASURED).select(*cell, F.lit("m").alias("kind"), F.lit(1.0).alias("value"))
    used = all_.where(F.col("layer").isin(channels))
    if robust:
        group = F.struct("site", F.when(F.col("layer").isin(*TOGETHER), TOGETHER[0]).otherwise(F.col("layer")).alias("layer"))
        used = normalize(used.withColumn("__group", group), "__group").withColumn("value", F.col("normalized"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c)).alias("kind")
    long = frame.select(*cell, F.lit("c").alias("kind"), F.lit(0.0).alias("value")).unionByName(seen).unionByName(used.select(*cell, name("x", "layer"), "value"))
    if objects is not None:
        found = label_targets(objects, sigma, grids, classes)
        both = F.inline(F.array(F.struct(name("s", "cls"), F.col("seg").cast("double").alias("value")), F.struct(name("h", "cls"), F.col("hm").alias("value"))))
        long = long.unionByName(found.select(*cell, both))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    stack = lambda kind, names: F.array(*(F.coalesce(at(kind + n), F.lit(0.0)) for n in names))
    targets = [] if objects is None else [stack("s", classes or []).alias("seg"), stack("h", classes or []).alias("hm")]
    wide = long.groupBy(*cell).agg(at("c").alias("__c"), at("m").alias("__m"), stack("x", channels).alias("x"), *targets).where("__c is not null").drop("__c")
    measured = known.where(F.col("layer") == MEASURED).select("site").distinct().withColumn("__has", F.lit(True))  # a row for each site
    wide = wide.join(measured, "site", "left").withColumn("valid", F.col("__m").isNotNull() | F.col("__has").isNull())
    return wide.select(*cell, "valid", "x", *(["seg", "hm"] if targets else []))


def site_facts(layers: DataFrame, grids: SiteGrids, channels: list[str], folders: DataFrame | None = None, classes: list[str] | None = None, needs: dict[str, list[str]] | None = None) -> DataFrame:
    """site, present (which channels it has), and with ``folders(site, code)`` observed (which classes its sources show; all, without any folder)."""
    held = layers.where("value is not null").groupBy("site").agg(*(F.max((F.col("layer") == c).cast("int")).alias(f"__{k}") for k, c in enumerate(channels)))
    flags = F.array(*(F.coalesce(F.col(f"__{k}"), F.lit(0)) == 1 for k in range(len(channels))))
    out = grids.table.select("site").join(held, "site", "left").select("site", flags.alias("present"))
    if folders is None:
        return out
    seen = class_validity(folders, classes or [], needs or {}).groupBy("site").agg(*(F.bool_or((F.col("cls") == c) & F.col("observed")).alias(f"__{k}") for k, c in enumerate(classes or [])))
    observed = F.array(*(F.coalesce(F.col(f"__{k}"), F.lit(True)) for k in range(len(classes or []))))
    return out.join(seen, "site", "left").select("site", "present", observed.alias("observed"))


def _covering(at: Column, size: Column, tile: int, stride: int) -> Column:
    """The starts of the windows along an axis that hold a cell: multiples of the stride, and the last one at the edge."""
    first, last = F.greatest(F.ceil((at - tile + 1) / stride), F.lit(0)), F.floor(at / stride)
    inner = F.filter(F.transform(F.sequence(first, last), lambda k: (k * stride).cast("int")), lambda s: s < size - tile)
    edge = F.when(at >= size - tile, F.array((size - tile).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(F.concat(inner, edge))


def tiles(pixels: DataFrame, grids: SiteGrids, tile: int, overlap: int) -> DataFrame:
    """site, row0, col0, h, w, positive and the arrays of pixels(site, row, col, valid, x[, seg, hm]) in tile * tile places, row by row; padding is 0 and not valid.

    A cell's windows follow from its place, so nothing is joined; a window gathers tile * tile cells, whatever a site's
    size. positive: a mask or a bump of at least a half (null without targets).
    """
    if not 0 <= overlap < tile:
        raise ValueError("the overlap lies between 0 and the tile size")
    data = [c for c in ("x", "seg", "hm") if c in pixels.columns]
    stride, height, width = tile - overlap, F.col("__height"), F.col("__width")
    placed = grids.attach(pixels.select("site", "row", "col", "valid", *data))
    spread = placed.withColumn("row0", F.explode(_covering(F.col("row"), height, tile, stride))).withColumn("col0", F.explode(_covering(F.col("col"), width, tile, stride)))
    place = lambda i, j: (i * tile + j).cast("int").alias("place")
    rows = spread.select("site", "row0", "col0", place(F.col("row") - F.col("row0"), F.col("col") - F.col("col0")), "valid", *data, "__height", "__width")
    # only sites smaller than a tile have padding, in one row or column of windows
    small = grids.table.where((height < tile) | (width < tile))
    starts = lambda size: F.when(size <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - tile - 1) / stride), F.lit(0))), lambda k: (k * stride).cast("int")), F.array((size - tile).cast("int")))))
    side = F.sequence(F.lit(0), F.lit(tile - 1))
    empty = small.withColumn("row0", F.explode(starts(height))).withColumn("col0", F.explode(starts(width))).withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).where((F.col("i") >= height) | (F.col("j") >= width))
    kinds = dict(rows.dtypes)
    rows = rows.unionByName(empty.select("site", "row0", "col0", place(F.col("i"), F.col("j")), F.lit(False).alias("valid"), *(F.lit(None).cast(kinds[c]).alias(c) for c in data), "__height", "__width"))
    cells = F.array_sort(F.collect_list(F.struct("place", "valid", *data)))
    whole = rows.groupBy("site", "row0", "col0").agg(cells.alias("cells"), F.least(F.first("__height"), F.lit(tile)).cast("int").alias("h"), F.least(F.first("__width"), F.lit(tile)).cast("int").alias("w"))

    def filled(c: str) -> Column:
        """The places' arrays; the padding takes zeros, as many as the others have values."""
        given = F.transform("cells", lambda p: p[c])
        zeros = F.transform(F.element_at(F.filter(given, lambda v: v.isNotNull()), 1), lambda v: v * 0)
        return F.transform(given, lambda v: F.coalesce(v, zeros))

    if "seg" in data:
        hit = F.exists("cells", lambda p: F.coalesce(F.exists(p["seg"], lambda v: v > 0) | F.exists(p["hm"], lambda v: v >= BUMP), F.lit(False)))
    else:
        hit = F.lit(None).cast("boolean")
    return whole.select("site", "row0", "col0", "h", "w", hit.alias("positive"), F.transform("cells", lambda p: p["valid"]).alias("valid"), *(filled(c).alias(c) for c in data))


def draw(items: DataFrame, n: int, pos_fraction: float, epochs: list[int], seed: int) -> DataFrame:
    """epoch, draw (0 to n - 1), site, row0, col0, positive: in each epoch n tiles with replacement, positives with a share of ``pos_fraction``, within a kind all alike; all tiles alike where there is one kind only (or positive is null).

    Fixed by the seed, the epoch and the tiles' places. Tiles of a kind are numbered in buckets by a hash, and a draw meets its tile
    by number, so neither tiles nor draws gather. No tiles: no rows.
    """
    if not 0 < pos_fraction < 1 or n < 0:
        raise ValueError("the share of positives lies between 0 and 1, and the number of draws isn't negative")
    whole = ["site", "row0", "col0"]
    base = cut(items.select(*whole, "positive", F.coalesce("positive", F.lit(False)).alias("__kind"), F.pmod(F.xxhash64(*whole), F.lit(BUCKETS)).alias("__bucket")))
    sizes = base.groupBy("__kind", "__bucket").agg(F.count("*").alias("__n"))  # at most 2 * BUCKETS rows
    upto = Window.partitionBy("__kind").orderBy("__bucket")
    sizes = cut(sizes.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")))
    total = {bool(r["__kind"]): r["n"] for r in sizes.groupBy("__kind").agg(F.sum("__n").alias("n")).collect()}
    if not total:
        return base.select(F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("draw"), *whole, "positive")
    number = F.row_number().over(Window.partitionBy("__kind", "__bucket").orderBy(*whole)) - 1
    numbered = base.withColumn("__at", number).join(F.broadcast(sizes), ["__kind", "__bucket"]).select(*whole, "positive", "__kind", (F.col("__at") + F.col("__before")).alias("__number"))
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), F.explode(F.array(*map(F.lit, epochs))).alias("epoch"))
    share = lambda salt: F.pmod(F.xxhash64("draw", "epoch", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    kind = (share("kind") < pos_fraction) if len(total) == 2 else F.lit(True in total)
    draws = draws.withColumn("__kind", kind)
    size = F.when(F.col("__kind"), total.get(True, 1)).otherwise(total.get(False, 1))
    draws = draws.withColumn("__number", F.least(F.floor(share("tile") * size), size - 1).cast("long"))
    return draws.join(numbered, ["__kind", "__number"]).select("epoch", "draw", *whole, "positive")


# -- queries ------------------------------------------------------------------

TILE, OVERLAP, CLASSES = 32, 8, ["0", "2"]


def _tiles(spark, sf_dir) -> DataFrame:
    grids = _grids(spark, sf_dir)
    means = with_cells(points(spark, sf_dir).where(INSIDE), grids).where("valid").groupBy("site", "row", "col").agg(F.avg("z").alias("dtm"), F.avg("intensity").alias("light"))
    layers = means.unpivot(["site", "row", "col"], ["dtm", "light"], "layer", "value")
    letters = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int"))
    objects = outlines(truths(spark, sf_dir)).select(letters.alias("site"), "id", F.col("cls").cast("string").alias("cls"), F.lit("Polygon").alias("geom_type"), "rings")
    return tiles(load_sites(layers, grids, ["light", "dtm", "absent"], objects, CLASSES, 1.5), grids, TILE, OVERLAP)


def q_dataset(spark, sf_dir):
    """All tiles of all sites: their valid cells, sums of channels and pixels of masks and bumps."""
    total = lambda c, k: F.aggregate(c, F.lit(0.0), lambda s, v: s + v[k])
    bumps = lambda k: F.size(F.filter("hm", lambda v: v[k] >= BUMP))
    return _tiles(spark, sf_dir).select(
        "site", "row0", "col0", "h", "w", "positive", F.size("x").alias("places"), F.size(F.filter("valid", lambda v: v)).alias("n_valid"),
        *(F.round(total("x", k), 4).alias(n) for k, n in enumerate(("light", "dtm", "absent"))), *(total("seg", k).cast("long").alias(f"mask_{c}") for k, c in enumerate(CLASSES)),
        *(bumps(k).alias(f"bumps_{c}") for k, c in enumerate(CLASSES)),
    )


QUERIES = {"dataset_tiles": q_dataset}
ORACLES = {
    "dataset_tiles": f"""WITH {POINTS}, {OBJECTS}, m AS MATERIALIZED (SELECT site, floor(y / 2)::INT AS row, floor(x / 2)::INT AS col, avg(z) AS dtm, avg(intensity) AS light FROM pts WHERE {INSIDE} GROUP BY ALL),
      f AS MATERIALIZED (SELECT site, r.range::INT AS row, c.range::INT AS col FROM (SELECT DISTINCT site FROM pts), range({ROWS}) r, range({COLS}) c),
      g AS MATERIALIZED (SELECT f.site, f.row, f.col, dtm, light FROM f LEFT JOIN m ON m.site = f.site AND m.row = f.row AND m.col = f.col),
      near AS (SELECT h.site, h.row, h.col, min_by(d.dtm, ((h.row - d.row) ** 2 + (h.col - d.col) ** 2)::BIGINT * 10000 + d.row * 100 + d.col) AS v FROM g h JOIN m d ON h.site = d.site AND (h.row - d.row) ** 2 + (h.col - d.col) ** 2 <= 49 WHERE h.dtm IS NULL GROUP BY ALL),
      u AS MATERIALIZED (SELECT g.site, g.row, g.col, coalesce(dtm, v) AS dtm, light FROM g LEFT JOIN near ON near.site = g.site AND near.row = g.row AND near.col = g.col),
      p AS (SELECT site, quantile_cont(dtm, [0.02, 0.5, 0.98]) AS d, quantile_cont(light, [0.02, 0.5, 0.98]) AS l FROM u GROUP BY site),
      x AS (SELECT u.site, row, col, dtm IS NOT NULL AS valid, CASE WHEN dtm IS NULL THEN 0 ELSE greatest(-8, least(8, (dtm - d[2]) / (d[3] - d[1]))) END AS dtm, CASE WHEN light IS NULL THEN 0 ELSE greatest(-8, least(8, (light - l[2]) / (l[3] - l[1]))) END AS light FROM u JOIN p USING (site)),
      o AS (SELECT ['A', 'N', 'R'][id % 3 + 1] AS site, cls, cx, cy, half FROM gt WHERE cls IN (0, 2)),
      y AS (SELECT f.site, f.row, f.col, bool_or(cls = 0 AND abs_in) AS s0, bool_or(cls = 2 AND abs_in) AS s2, bool_or(cls = 0 AND bump) AS h0, bool_or(cls = 2 AND bump) AS h2 FROM (
        SELECT f.site, f.row, f.col, cls, 2 * col + 1 >= cx - half AND 2 * col + 1 < cx + half AND 2 * row + 1 >= cy - half AND 2 * row + 1 < cy + half AS abs_in,
          exp(-((cx / 2 - 0.5 - col) ** 2 + (cy / 2 - 0.5 - row) ** 2) / 4.5) >= 0.5 AS bump FROM f JOIN o USING (site)) f GROUP BY ALL),
      t AS (SELECT * FROM (VALUES (0), (18)) r(row0), (VALUES (0), (21)) c(col0))
      SELECT x.site, row0, col0, 32 AS h, 32 AS w, coalesce(bool_or(s0 OR s2 OR h0 OR h2), false) AS positive, count(*)::INT AS places, count_if(valid)::INT AS n_valid, round(sum(light), 4) AS light, round(sum(dtm), 4) AS dtm, 0::DOUBLE AS absent,
        count_if(s0)::BIGINT AS mask_0, count_if(s2)::BIGINT AS mask_2, count_if(h0)::INT AS bumps_0, count_if(h2)::INT AS bumps_2
      FROM t JOIN x ON x.row >= row0 AND x.row < row0 + 32 AND x.col >= col0 AND x.col < col0 + 32 LEFT JOIN y ON y.site = x.site AND y.row = x.row AND y.col = x.col GROUP BY ALL""",
}
