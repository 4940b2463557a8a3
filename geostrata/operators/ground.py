"""Ground filter: progressive morphology over minimum surfaces, refined until few points change.

Points stay distributed; the surface is a table of cells, written after each round so
that plans stay short. Two cell rules hold: points of the outer half cell don't enter the
first minimum surface but take the nearest cell when they are classified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.window2d import gradient
from ..model import BROADCAST_SITES, SiteGrids
from ..views import POINTS, full_grid, points
from .terrain import fill_nearest, progressive_opening


@dataclass(frozen=True)
class Preset:
    height: float
    slope: float
    rounds: int
    windows: tuple[int, ...]


#: Presets (fixed values).
PRESETS = {"strict": Preset(0.3, 0.3, 8, (3, 5, 7, 9, 11, 13, 15)), "soft": Preset(1.0, 0.15, 4, (5, 9, 15))}


#: Surfaces are broadcast up to this many cells (32 MB), so the points are neither shuffled nor sorted; beyond it they meet their cells by a shuffle.
BROADCAST_CELLS = 1_000_000


def cover(pts: DataFrame, cell: float, keys: tuple[str, ...]) -> SiteGrids:
    """The internal grids over all points of each site."""
    b = pts.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x1"), F.min("y").alias("y_min"), F.max("y").alias("y1"))
    size = lambda a, z: (F.ceil((F.col(z) - F.col(a)) / cell) + 1).cast("int")
    return SiteGrids(cut(b.select(*keys, "x_min", "y_min", F.lit(float(cell)).alias("pixel_size"), size("x_min", "x1").alias("width"), size("y_min", "y1").alias("height"))), keys)


def _placed(pts: DataFrame, grid: SiteGrids) -> DataFrame:
    """Adds inner (whether the point enters surfaces), row and col (clipped)."""
    px, py = grid.pixel(F.col("x"), F.col("y"))
    col, row = F.floor(px), F.floor(py)
    inner = col.between(0, grid.width - 1) & row.between(0, grid.height - 1)
    clip = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, v)).cast("int")
    return grid.detach(grid.attach(pts).withColumns({"inner": inner, "row": clip(row, grid.height), "col": clip(col, grid.width)}))


def _surface(pts: DataFrame, grid: SiteGrids, preset: Preset, cell: float) -> DataFrame:
    """*keys, row, col, surface, slope: filled minimum of the points, opened, and its gradient's length."""
    k = grid.keys
    low = pts.groupBy(*k, "row", "col").agg(F.min("z").alias("low"))
    frame = full_grid(pts.sparkSession, grid).join(low.select(*k).distinct(), list(k), "left_semi")
    filled = fill_nearest(frame.join(low, [*k, "row", "col"], "left"), ["low"], k).drop("observed")
    opened = progressive_opening(filled, "low", preset.windows, k)
    sloped = opened.withColumns({"gx": gradient("opened", "x", cell, k), "gy": gradient("opened", "y", cell, k)})
    return cut(sloped.select(*k, "row", "col", F.col("opened").alias("surface"), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("slope")))


def filter_ground(pts: DataFrame, preset: str = "soft", cell: float = 1.0, min_change: float = 0.01, keys: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """pts with ground, and the most rounds that a site took. Points on the refined surface are those classified as ground.

    Each site (``keys``) has its own grid and ends on its own; without keys all points are one site.
    """
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    p, k = PRESETS[preset], keys or ("__all",)
    pts = pts if keys else pts.withColumn("__all", F.lit(1))
    grid = cover(pts, cell, k)
    if grid.table.isEmpty():
        raise ValueError("an empty point cloud has no ground")
    placed = _placed(pts, grid)
    sites, cells = grid.table.agg(F.count("*"), F.sum(F.col("__width").cast("long") * F.col("__height"))).first()
    # of a single site all points have one key, which a shuffle would bring to one task
    by_site = F.broadcast if sites <= BROADCAST_SITES else lambda x: x
    by_cell = F.broadcast if cells <= BROADCAST_CELLS else lambda x: x
    state, out, rounds = grid.table.select(*k, F.lit(0).cast("long").alias("before")), [], 0
    surface = _surface(placed.where("inner"), grid, p, cell)
    while True:
        rounds += 1
        ground = F.coalesce((F.col("z") - F.col("surface") <= p.height) & (F.col("slope") <= p.slope), F.lit(False))
        marked = cut(placed.join(by_cell(surface), [*k, "row", "col"], "left").withColumn("ground", ground).drop("surface", "slope"))
        now = marked.groupBy(*k).agg(F.count_if("ground").alias("now")).join(state, list(k))
        change = F.abs(F.col("now") - F.col("before")) / F.greatest(F.col("before"), F.lit(1))
        done = ((change < min_change) & F.lit(rounds > 1)) | F.lit(rounds == p.rounds) | (F.col("now") == 0)
        now = cut(now.withColumn("done", done))
        out.append(marked.join(by_site(now.where("done").select(*k)), list(k), "left_semi"))
        state = now.where("not done").select(*k, F.col("now").alias("before"))
        if state.isEmpty():
            break
        placed = marked.join(by_site(state.select(*k)), list(k), "left_semi")
        surface, placed = _surface(placed.where("ground"), grid, p, cell), placed.drop("ground")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select(*(c for c in pts.columns if c != "__all"), "ground"), rounds


def q_ground(spark, sf_dir):
    found, _ = filter_ground(points(spark, sf_dir), "soft", 2.0)
    return found.groupBy("site", "ground").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))


def _sql(p: Preset, cell: float) -> str:
    """``marked``: the points of ``pts`` with ground, all rounds written out; the first round that ends the search counts."""
    pick = lambda f, v, by, order, r: f"{f}({v}) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    out = [POINTS, f"""b AS (SELECT min(x) AS x0, min(y) AS y0, ceil((max(x) - min(x)) / {cell})::INT + 1 AS w, ceil((max(y) - min(y)) / {cell})::INT + 1 AS h FROM pts)""",
           f"""m0 AS MATERIALIZED (SELECT * EXCLUDE (x0, y0, w, h, fr, fc), greatest(0, least(h - 1, fr))::INT AS r, greatest(0, least(w - 1, fc))::INT AS c, fr BETWEEN 0 AND h - 1 AND fc BETWEEN 0 AND w - 1 AS g0
             FROM (SELECT *, floor((x - x0) / {cell} - 0.5) AS fc, floor((y - y0) / {cell} - 0.5) AS fr FROM pts, b))""",
           "fr AS (SELECT r, unnest(range(w))::INT AS c FROM (SELECT w, unnest(range(h))::INT AS r FROM b))"]
    for i in range(1, p.rounds + 1):
        out.append(f"l{i} AS MATERIALIZED (SELECT fr.r, fr.c, v FROM fr LEFT JOIN (SELECT r, c, min(z) AS v FROM m{i - 1} WHERE g{i - 1} GROUP BY ALL) q ON fr.r = q.r AND fr.c = q.c)")
        out.append(f"""s{i}_0 AS (SELECT h.r, h.c, coalesce(h.v, f.v) AS v FROM l{i} h LEFT JOIN (SELECT a.r, a.c, min_by(d.v, ((d.r - a.r) * (d.r - a.r) + (d.c - a.c) * (d.c - a.c))::BIGINT * 10000000000 + d.r * 100000 + d.c) AS v
             FROM (SELECT * FROM l{i} WHERE v IS NULL) a, (SELECT * FROM l{i} WHERE v IS NOT NULL) d GROUP BY a.r, a.c) f ON h.r = f.r AND h.c = f.c)""")
        source = f"s{i}_0"
        for window in p.windows:
            for f in ("min", "max"):
                for by, order in (("r", "c"), ("c", "r")):
                    name = f"{source}{by}"
                    out.append(f"{name} AS (SELECT r, c, {pick(f, 'v', by, order, window // 2)} AS v FROM {source})")
                    source = name
        grad = lambda a, z: f"CASE WHEN {a} IS NULL THEN ({z} - v) / {cell} WHEN {z} IS NULL THEN (v - {a}) / {cell} ELSE ({z} - {a}) / {2 * cell} END"
        out.append(f"""u{i} AS (SELECT r, c, v, {grad('xl', 'xr')} AS gx, {grad('yl', 'yr')} AS gy FROM (SELECT *, lag(v) OVER x AS xl, lead(v) OVER x AS xr, lag(v) OVER y AS yl, lead(v) OVER y AS yr FROM {source}
             WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)))""")
        out.append(f"m{i} AS MATERIALIZED (SELECT m.*, coalesce(m.z - u.v <= {p.height} AND sqrt(u.gx * u.gx + u.gy * u.gy) <= {p.slope}, false) AS g{i} FROM m{i - 1} m LEFT JOIN u{i} u ON m.r = u.r AND m.c = u.c)")
    n = p.rounds
    ends = "".join(f" WHEN n{i} = 0{f' OR abs(n{i} - n{i - 1}) / greatest(n{i - 1}, 1)::DOUBLE < 0.01' if i > 1 else ''} THEN {i}" for i in range(1, n))
    out.append(f"ends AS (SELECT CASE{ends} ELSE {n} END AS k FROM (SELECT {', '.join(f'count_if(g{i}) AS n{i}' for i in range(1, n + 1))} FROM m{n}))")
    out.append(f"marked AS MATERIALIZED (SELECT site, x, y, z, intensity, return_number, list_extract([{', '.join(f'g{i}' for i in range(1, n + 1))}], k) AS ground FROM m{n}, ends)")
    return ", ".join(out)


#: The query's ground filter as the start of a WITH clause.
MARKED = _sql(PRESETS["soft"], 2.0)

QUERIES = {"ground_filter": q_ground}
ORACLES = {"ground_filter": f"WITH {MARKED} SELECT site, ground, count(*) AS n, round(avg(z), 6) AS mean_z FROM marked GROUP BY ALL"}
