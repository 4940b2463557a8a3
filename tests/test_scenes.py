"""Scenes with closed-form answers, kernels, sources, sinks and streams."""

import json
import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.functions import names, polygons, projection
from geostrata.functions.window2d import gaussian_weights
from geostrata.model import Grid, SiteGrids
from geostrata.operators import catalogue, cells, geometry, ground, matching, rasters, terrain
from geostrata.plans import pipelines
from geostrata.sources import geojson, gtiff, las
from geostrata.streaming import cells as stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def surface(spark, z):
    rows = [(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, z double")


def matrix(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", value).collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def cloud(spark, x, y, z):
    n = len(x)
    return spark.createDataFrame([("s", float(a), float(b), float(c), float(k % 10), 1 + k % 3, "2") for k, (a, b, c) in enumerate(zip(x, y, z, strict=True))] if n else [], "site string, x double, y double, z double, intensity double, return_number int, classification string")


# -- cells --------------------------------------------------------------------


def test_cell_edges(spark):
    grid = Grid(0, 0, 1, 3, 3)
    x = [0, 0.1, 0.49, 0.5, 0.99, 1, 2.99, 3, -0.01, math.nan, math.inf]
    got = cells.with_cells(spark.createDataFrame([(k, float(v), 0.1) for k, v in enumerate(x)], "k int, x double, y double"), grid).orderBy("k").collect()
    assert [r["col"] for r in got] == [0, 0, 0, 0, 0, 1, 2, -1, -1, -1, -1]


def test_bins_follow_a_plane(spark):
    r = np.random.default_rng(0)
    x, y = r.uniform(0, 20, (2, 3000))
    found = cells.bin_points(cloud(spark, x, y, 0.1 * x), Grid(0, 0, 1, 20, 20)).collect()
    assert max(abs(b["value"] - 0.1 * (b["col"] + 0.5)) for b in found) < 0.06
    with pytest.raises(ValueError):
        cells.bin_points(cloud(spark, x, y, x), Grid(), "mode")
    with pytest.raises(ValueError):
        Grid.from_dict({"pixel": 1})


# -- terrain ------------------------------------------------------------------


def test_tilted_planes(spark):
    col = np.tile(np.arange(9.0), (9, 1))
    east = terrain.slope_aspect(surface(spark, 0.1 * col), 1.0)
    assert np.allclose(matrix(east, "aspect", (9, 9)), 270) and np.allclose(matrix(east, "slope", (9, 9)), math.degrees(math.atan(0.1)))
    flat = terrain.slope_aspect(surface(spark, 0 * col), 1.0)
    assert np.allclose(matrix(flat, "aspect", (9, 9)), 180) and np.allclose(matrix(flat, "slope", (9, 9)), 0)


def test_flat_surface_derivatives(spark):
    grid, flat = Grid(0, 0, 1, 9, 9), surface(spark, np.full((9, 9), 10.0))
    assert np.allclose(matrix(terrain.slrm(flat, 1.0, grid), "slrm", (9, 9)), 0)
    assert np.allclose(matrix(terrain.curvature(flat, 1.0, grid), "curvature", (9, 9)), 0)
    assert np.allclose(matrix(terrain.tpi_tri(flat, 2, grid), "tri", (9, 9)), 0, atol=1e-6)
    up = terrain.openness(flat, 3, 8, grid)
    assert np.allclose(matrix(up, "positive", (9, 9)), 90) and np.allclose(matrix(up, "sky_view", (9, 9)), 0.5)


def test_convolution_equals_numpy(spark):
    z = np.random.default_rng(1).random((7, 11))
    w = np.array(gaussian_weights(1.0))
    pad = np.pad(z, 4, mode="edge")
    want = sum(w[i] * w[j] * pad[i : i + 7, j : j + 11] for i in range(9) for j in range(9))
    got = matrix(terrain.slrm(surface(spark, z), 1.0, Grid(0, 0, 1, 11, 7)), "slrm", (7, 11))
    assert np.allclose(got, z - want)


def test_fill_takes_nearest_with_ties_by_row(spark):
    z = np.full((5, 5), np.nan)
    z[0, 2], z[4, 2] = 1.0, 2.0
    df = surface(spark, z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = matrix(terrain.fill_nearest(df, ["z"]), "z", (5, 5))
    assert got[2, 2] == 1 and got[1, 0] == 1 and got[3, 4] == 2 and not np.isnan(got).any()


def test_long_winding_holes_stay_whole(spark, sf_dir):
    terrain.q_holes(spark, sf_dir)  # sets the checkpoint folder
    stairs = [(k, c) for k in range(150) for c in (150 - k, 151 - k)]
    winding = [(r, 200 + c) for r in range(0, 160, 2) for c in range(3)] + [(r, 200 + r % 4 - 1) for r in range(1, 159, 2)]
    found = terrain.hole_components(spark.createDataFrame([*stairs, *winding, (5, 400)], "row int, col int"))
    got = {(r["label"], r["n"]) for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {(150, len(stairs)), (200, len(winding)), (5 * 2**32 + 400, 1)}


def test_fill_reaches_any_distance_and_keeps_rows(spark):
    z = np.full((150, 9), np.nan)
    z[149, 3], z[149, 5], z[0, 8] = 1.0, 2.0, 3.0
    df = surface(spark, z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    found = terrain.fill_nearest(df, ["z"])
    r, c = np.indices(z.shape)
    order = np.stack([((r - i) ** 2 + (c - j) ** 2) * 10_000 + i * 10 + j for i, j in ((149, 3), (149, 5), (0, 8))])
    assert found.count() == z.size and np.array_equal(matrix(found, "z", z.shape), order.argmin(0) + 1.0)
    none = terrain.fill_nearest(df.withColumn("z", F.lit(None).cast("double")), ["z"])
    assert none.where("z is null and not observed").count() == z.size


@pytest.mark.parametrize("limit", [None, 3.0])
def test_inverse_distance_equals_a_loop(spark, limit):
    r = np.random.default_rng(3)
    z = np.where(r.random((40, 13)) < 0.04, r.normal(0, 5, (40, 13)), np.nan)
    found = matrix(terrain.fill_idw(surface(spark, z).withColumn("z", F.when(~F.isnan("z"), F.col("z"))), "z", limit, 5, 1.5), "z", z.shape).astype(float)
    known = np.argwhere(~np.isnan(z))
    for i, j in np.argwhere(np.isnan(z)):
        d2 = ((known - (i, j)) ** 2).sum(1)
        near = np.lexsort((known[:, 1], known[:, 0], d2))[:5]
        w = d2[near] ** -0.75
        want = (w * z[tuple(known[near].T)]).sum() / w.sum() if limit is None or d2.min() <= limit**2 else np.nan
        assert np.isclose(found[i, j], want, equal_nan=True)


@pytest.mark.parametrize("fill", ["idw", "nearest"])
def test_large_holes_stay(spark, fill):
    r, c = (a.ravel() for a in np.indices((8, 12)))
    gone = ((r < 3) & (c < 4)) | ((r == 5) & (c > 6) & (c < 9))  # a hole of 12 cells and one of 2
    pts = cloud(spark, c[~gone] + 0.5, r[~gone] + 0.5, np.full((~gone).sum(), 7.0))
    found = terrain.build_dtm(pts, Grid(0, 0, 1, 12, 8), max_hole=11, fill=fill)
    assert found.count() == 96 and found.where("z is null").count() == 12 == found.where("row < 3 and col < 4 and hole").count()
    assert found.where("hole and z = 7 and n = 0").count() == 2
    layers = terrain.relief_layers(found, Grid(0, 0, 1, 12, 8), terrain.Relief(slrm=(1,), openness=(2, 4), curvature=(1,), tpi=(1,), tri=(1,)))
    assert layers.where("slope = 0 and abs(slrm_sigma_1) < 1e-9 and abs(tpi_radius_1) < 1e-9 and positive_openness = 90").count() == 84
    assert layers.where("slope is null and sky_view_factor is null and aspect_sin is null").count() == 12


def test_ground_keeps_points_far_from_any_surface(spark):
    r = np.random.default_rng(7)
    x, y = r.uniform(0, 6, (2, 200))
    x[0], y[0] = 200.0, 3.0
    x[1], y[1] = 100.0, 3.0
    found, _ = ground.filter_ground(cloud(spark, x, y, np.where(np.arange(200) == 1, 10.0, 0.0)), "soft", 1.0)
    assert found.count() == 200 and found.where("ground is null").count() == 0
    one, _ = ground.filter_ground(cloud(spark, [1.0], [1.0], [1.0]))
    assert one.count() == 1


def test_ground_keeps_plain_and_drops_trees(spark):
    r = np.random.default_rng(2)
    x, y = r.uniform(0, 60, (2, 4000))
    z = r.normal(0, 0.05, 4000)
    z[:300] += 10
    found, rounds = ground.filter_ground(cloud(spark, x, y, z), "soft", 2.0)
    assert 1 <= rounds <= 4
    low = found.where("z < 5").agg(F.avg(F.col("ground").cast("int"))).first()[0]
    assert low > 0.9 and found.where("z > 5 and ground").count() == 0
    with pytest.raises(ValueError):
        ground.filter_ground(cloud(spark, x, y, z), "hard")
    with pytest.raises(ValueError):
        ground.filter_ground(cloud(spark, [], [], []))


# -- rasters ------------------------------------------------------------------


def test_stitched_tiles_give_the_field_back(spark):
    f = np.sin(np.arange(60) / 20)[:, None] + np.cos(np.arange(70) / 30)[None, :]
    field = surface(spark, f).withColumnRenamed("z", "value")
    parts = rasters.tile_cells(field, rasters.tile_index(spark, 60, 70, 32, 8))
    assert np.abs(matrix(rasters.stitch(parts, 32), "value", (60, 70)) - f).max() < 1e-9
    assert rasters.axis_starts(1024, 256, 224) == [0, 224, 448, 672, 768] and rasters.axis_starts(10, 32, 8) == [0]


def test_shift_is_found(spark):
    z = np.random.default_rng(3).random((30, 30))
    a = surface(spark, z).withColumnRenamed("z", "value")
    b = surface(spark, np.roll(np.roll(z, 2, 0), -3, 1)).withColumnRenamed("z", "value")
    got = rasters.estimate_shift(a, b, 4, Grid(0, 0, 1, 30, 30)).first()
    assert (got["dx"], got["dy"]) == (-3, 2) and got["confidence"] > 0.99


def test_uninformative_bands_are_skipped(spark):
    bands = spark.createDataFrame([(0, k, 100.0 + k, 150.0 - k, 50.0) for k in range(9)], "row int, col int, red double, green double, nir double")
    found, skipped = rasters.spectral_indices(bands)
    assert skipped == ["gndvi", "ndvi", "ndwi", "savi", "sr"] and found.columns == ["row", "col", "ari"]


# -- objects ------------------------------------------------------------------


def square(x, y, s):
    return np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)


def test_iou_is_exact():
    a = [square(0, 0, 10)]
    assert polygons.iou(a, [square(5, 0, 10)]) == pytest.approx(1 / 3) and polygons.iou(a, a) == pytest.approx(1)
    assert polygons.iou(a, [square(20, 0, 5)]) == 0 and polygons.iou(a, [square(10, 0, 5)]) == 0
    assert polygons.iou(a, [square(0, 0, 10), square(2, 2, 6)]) == pytest.approx(0.64)
    turned = [np.array([(5, -2), (12, 5), (5, 12), (-2, 5)], float)]  # cuts the square's corners: 98 less 4 triangles of 4 in common
    assert polygons.overlap(a, turned) == pytest.approx((82, 116))
    r = np.random.default_rng(6)
    for _ in range(20):
        shapes = []
        for _ in range(2):
            t = np.sort(r.uniform(0, 2 * np.pi, 9))
            shapes.append([np.stack((np.cos(t), np.sin(t)), 1) * r.uniform(2, 5, (9, 1)) + r.uniform(-1, 1, 2), square(-0.5, -0.5, 1)])
        x, y = np.meshgrid(np.linspace(-7, 7, 701), np.linspace(-7, 7, 701))
        odd = []
        for rings in shapes:
            hit = np.zeros(x.shape, bool)
            for ring in rings:
                for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                    hit ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay + (by == ay)) * (bx - ax))
            odd.append(hit)
        shared, either = polygons.overlap(*shapes)
        assert shared == pytest.approx((odd[0] & odd[1]).sum() * 0.0004, abs=0.15) and either == pytest.approx((odd[0] | odd[1]).sum() * 0.0004, abs=0.15)


def test_simplify():
    line = np.array([(0, 0), (5, 0.01), (10, 0), (10, 10), (0, 10)], float)
    assert len(polygons.simplify(line, 0.5)) == 4 and len(polygons.simplify(line, 0.001)) == 5
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    ring = np.stack((np.cos(t), np.sin(t)), 1) * 50
    kept = polygons.simplify(ring, 0.5)
    assert 8 < len(kept) < 60 and polygons.ring_area(kept) == pytest.approx(polygons.ring_area(ring), rel=0.03)
    assert {tuple(p) for p in kept} == {tuple(p) for p in polygons.simplify(np.roll(ring, 77, axis=0), 0.5)}
    assert len(polygons.simplify(ring[:3], 99.0)) == 3 and len(polygons.simplify(ring, 1000.0)) == 200


def test_parts_are_8_connected(spark):
    big = np.random.default_rng(4).random((25, 30)) > 0.6
    rows = surface(spark, big.astype(float)).select(F.lit("s").alias("site"), F.lit("a").alias("cls"), "row", "col", F.col("z").alias("value"))
    got = {(r["row"], r["col"]): r["part"] for r in geometry.label_parts(rows, 0.5).collect()}
    assert len(got) == big.sum()
    want, seen = {}, set()
    for r, c in zip(*np.nonzero(big), strict=True):
        if (r, c) in seen:
            continue
        work, first = [(r, c)], r * 2**32 + c  # row order: the first cell met is the smallest
        seen.add((r, c))
        while work:
            i, j = work.pop()
            want[i, j] = first
            for cell in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if cell not in seen and 0 <= cell[0] < 25 and 0 <= cell[1] < 30 and big[cell]:
                    seen.add(cell)
                    work.append(cell)
    assert got == want


def test_vectorized_disc_and_hole(spark):
    r, c = np.indices((40, 40))
    d = np.hypot(r - 20, c - 20)
    field = np.where((d <= 12) & (d >= 4), 1.0, 0.0)
    rows = surface(spark, field).select(F.lit("s").alias("site"), F.lit("a").alias("cls"), "row", "col", F.col("z").alias("value"))
    got = geometry.vectorize(rows, tolerance=0.2).collect()
    assert len(got) == 1 and got[0]["n_cells"] == field.sum() and len(got[0]["rings"]) == 2
    outer, hole = (np.array([(p["x"], p["y"]) for p in ring]) for ring in got[0]["rings"])
    assert abs(polygons.ring_area(outer)) == pytest.approx(math.pi * 144, rel=0.05) and abs(polygons.ring_area(hole)) == pytest.approx(math.pi * 16, rel=0.2)
    assert polygons.ring_area(outer) * polygons.ring_area(hole) < 0


def objects(spark, rows, score=True):
    schema = "id long, cx double, cy double, half double, cls long" + (", score double" if score else "")
    return geometry.squares(spark.createDataFrame(rows, schema)).withColumn("geom_type", F.lit("Polygon"))


def test_duplicates_and_empties(spark):
    gts = objects(spark, [(1, 5.0, 5.0, 2.0, 0)], False)
    preds = objects(spark, [(10, 5.0, 5.0, 2.0, 0, 0.6), (11, 5.1, 5.0, 2.0, 0, 0.9)])
    pairs = matching.match(preds, gts)
    assert [(r["id"], r["gt_id"]) for r in pairs.collect()] == [(11, 1)]
    assert matching.errors(preds, gts, pairs).collect()[0]["error"] == "duplicate"
    none = preds.limit(0)
    total = matching.evaluate(none, gts, matching.match(none, gts)).where("cls is null").first()
    assert (total["tp"], total["fp"], total["fn"], total["f1"]) == (0, 0, 1, 0.0)
    assert matching.nms(preds, 3.0).count() == 1 and matching.nms(preds, 0.0).count() == 2


def test_points_match_within_a_radius(spark):
    gts = spark.createDataFrame([(1, 0, "Point", [[(0.0, 0.0)]]), (2, 0, "Point", [[(4.0, 0.0)]])], "id long, cls long, geom_type string, rings array<array<struct<x:double,y:double>>>")
    preds = objects(spark, [(10, 1.0, 0.0, 0.5, 0, 0.9), (11, 4.0, 3.0, 0.2, 0, 0.5), (12, 20.0, 20.0, 1.0, 0, 0.4)])
    got = {(r["id"], r["gt_id"]): r["quality"] for r in matching.match(preds, gts, radius=3.0).collect()}
    assert got == {(10, 1): pytest.approx(1 - 0.5 / 3), (11, 2): pytest.approx(0.5)}
    assert {r["id"] for r in matching.match(preds, gts, radius=2.0).collect()} == {10}


def test_choices_in_rounds_equal_greedy_loops(spark):
    r = np.random.default_rng(9)
    rows = {(k, int(p), int(g)): (float(s[p]), float(q)) for k in (0, 1) for s in [r.integers(0, 6, 60) / 6] for p, g, q in zip(r.integers(0, 60, 300), r.integers(0, 40, 300), r.integers(1, 9, 300) / 9, strict=True)}
    pairs = spark.createDataFrame([(*key, *v) for key, v in rows.items()], "k int, id long, gt_id long, score double, quality double")
    want = set()
    for k in (0, 1):
        taken = set()
        for p in sorted({i for kk, i, _ in rows if kk == k}, key=lambda i: (-next(v[0] for (kk, j, _), v in rows.items() if (kk, j) == (k, i)), i)):
            free = [(-v[1], g) for (kk, i, g), v in rows.items() if (kk, i) == (k, p) and g not in taken]
            if free:
                taken.add(min(free)[1])
                want.add((k, p, min(free)[1]))
    assert {(x["k"], x["id"], x["gt_id"]) for x in matching.settle(pairs, ("k",)).collect()} == want
    edges = {(k, *sorted((int(a), int(b)))) for k in (0, 1) for a, b in r.integers(0, 80, (200, 2)) if a != b}
    gone = set()
    for k in (0, 1):
        for a in range(80):
            if (k, a) not in gone:
                gone |= {(k, b) for kk, i, b in edges if (kk, i) == (k, a)}
    got = matching.suppressed(spark.createDataFrame(sorted(edges), "k int, id long, other long"), ("k",))
    assert {(x["k"], x["id"]) for x in got.collect()} == gone


def test_two_sites_in_one_call_equal_two_calls(spark):
    r = np.random.default_rng(11)
    grids = {"a": Grid(0, 0, 1, 12, 9), "b": Grid(100, 50, 2, 7, 8)}
    clouds = {n: cloud(spark, r.uniform(g.x_min - 1, g.x_min + g.width * g.pixel_size + 1, 150), r.uniform(g.y_min - 1, g.y_min + g.height * g.pixel_size + 1, 150), r.normal(0, 1, 150)).withColumn("site", F.lit(n)) for n, g in grids.items()}
    frames = SiteGrids(spark.createDataFrame([(n, float(g.x_min), float(g.y_min), float(g.pixel_size), g.width, g.height) for n, g in grids.items()], "site string, x_min double, y_min double, pixel_size double, width int, height int"))
    both = clouds["a"].unionByName(clouds["b"])
    dem = terrain.elevation(both, frames)
    plans = {
        "build": (pipelines.build_site(both, frames), lambda n: pipelines.build_site(clouds[n], grids[n])),
        "open": (terrain.openness(dem, 3, 8, frames), lambda n: terrain.openness(terrain.elevation(clouds[n], grids[n]), 3, 8, grids[n])),
        "curve": (terrain.curvature(terrain.slrm(dem, 1.0, frames), 1.0, frames), lambda n: terrain.curvature(terrain.slrm(terrain.elevation(clouds[n], grids[n]), 1.0, grids[n]), 1.0, grids[n])),
        "ground": (ground.filter_ground(both, "soft", 2.0, keys=("site",))[0], lambda n: ground.filter_ground(clouds[n], "soft", 2.0)[0]),
    }
    for name, (joint, alone) in plans.items():
        for n in grids:
            one = alone(n).drop("site")
            flat = lambda df: sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in x]) for x in df.select(*one.columns).collect())  # noqa: B023, E731
            assert flat(joint.where(F.col("site") == n)) == flat(one), name


def test_models_of_two_sites_equal_two_models(spark):
    r = np.random.default_rng(5)
    grids = {"a": Grid(0, 0, 1, 7, 6), "b": Grid(100, 50, 2, 5, 8)}
    clouds = {n: cloud(spark, r.uniform(g.x_min, g.x_min + g.width * g.pixel_size, 20), r.uniform(g.y_min, g.y_min + g.height * g.pixel_size, 20), r.normal(0, 1, 20)).withColumn("site", F.lit(n)) for n, g in grids.items()}
    frames = SiteGrids(spark.createDataFrame([(n, float(g.x_min), float(g.y_min), float(g.pixel_size), g.width, g.height) for n, g in grids.items()], "site string, x_min double, y_min double, pixel_size double, width int, height int"))
    few = terrain.Relief((315,), slrm=(1,), openness=(2, 4), curvature=(0.5,), tpi=(1,), tri=(2,))

    def layers(pts, grid):
        dtm = terrain.build_dtm(pts, grid, max_hole=3)
        return dtm.join(terrain.relief_layers(dtm, grid, few), [*grid.keys, "row", "col"])

    joint = layers(clouds["a"].unionByName(clouds["b"]), frames).toPandas()
    for n, grid in grids.items():
        alone = layers(clouds[n], grid).toPandas().sort_values(["row", "col"]).reset_index(drop=True)
        part = joint[joint["site"] == n].sort_values(["row", "col"]).reset_index(drop=True)[alone.columns]
        pd.testing.assert_frame_equal(part, alone, check_dtype=False)


def test_classes_are_detected_apart(spark):
    r, c = np.indices((40, 40))
    bump = lambda i, j: np.exp(-((r - i) ** 2 + (c - j) ** 2) / 8)
    fields = {0: 0.9 * bump(10, 10), 1: 0.8 * bump(10, 12), 2: 0.7 * bump(30, 25)}
    cells_of = [surface(spark, f).withColumnRenamed("z", "value").withColumn("cls", F.lit(k)) for k, f in fields.items()]
    parts = rasters.tile_cells(cells_of[0].unionByName(cells_of[1]).unionByName(cells_of[2]), rasters.tile_index(spark, 40, 40, 32, 8))
    got = [(d["cls"], round(d["cx"], 6), round(d["cy"], 6), round(d["score"], 6)) for d in pipelines.detect(parts, 32, 6.0, 10).orderBy("cls").collect()]
    assert got == [(0, 10.0, 10.0, 0.9), (1, 12.0, 10.0, 0.8), (2, 25.0, 30.0, 0.7)]
    assert [d["cls"] for d in pipelines.detect(parts, 32, 6.0, 2).orderBy("cls").collect()] == [0, 1]


# -- names and projections ------------------------------------------------------


def test_refs_and_ranges(spark):
    got = catalogue.parse_refs(spark.createDataFrame([("014-016, 030,200_X_2",), ("024-022",)], "item string")).collect()
    assert {r["number"] for r in got if r["number"] is not None} == {14, 15, 16, 30, 22, 23, 24} and {r["name"] for r in got} == {None, "200_X_2"}


def test_split_is_stable(spark):
    import hashlib

    few = spark.createDataFrame([(f"s{k}", f"g{k % 29}") for k in range(29)], "name string, grp string")
    more = spark.createDataFrame([(f"s{k}", f"g{k}") for k in range(59)], "name string, grp string")
    a, b = ({r["grp"]: r["split"] for r in catalogue.assign_split(d).collect()} for d in (few, more))
    assert all(b[g] == s for g, s in a.items())
    share = int.from_bytes(hashlib.sha1(b"42:g3").digest()[:8], "big") / 2**64
    assert b["g3"] == ("test" if share < 0.15 else "val" if share < 0.3 else "train")


def test_projections(spark):
    one = spark.range(1)
    e, n = projection.utm(F.lit(37.6173), F.lit(55.7558), 37)
    lon, lat = projection.from_utm(e, n, 37)
    got = one.select(e.alias("e"), n.alias("n"), lon.alias("lon"), lat.alias("lat"), names.transliterate(F.lit("Курган Щит №7")).alias("t")).first()
    assert got["lon"] == pytest.approx(37.6173, abs=1e-7) and got["lat"] == pytest.approx(55.7558, abs=1e-7)
    assert got["e"] == pytest.approx(413_220, abs=300) and got["n"] == pytest.approx(6_179_800, abs=600) and got["t"] == "Kurgan_Shchit_7"
    with pytest.raises(ValueError):
        projection.to_lon_lat(1, F.lit(0), F.lit(0))


# -- sources and sinks ----------------------------------------------------------


def test_las_round_trip(spark, tmp_path):
    r = np.random.default_rng(5)
    x, y, z = 500_000 + r.uniform(0, 100, 5000), 6_200_000 + r.uniform(0, 100, 5000), r.normal(0, 1, 5000)
    las.write(str(tmp_path / "a.las"), x, y, z, np.arange(5000) % 100, 1 + np.arange(5000) % 3, 2)
    head = las.read_header(str(tmp_path / "a.las"))
    assert head.count == 5000 and head.maxima[0] == pytest.approx(x.max())
    got = las.read_points(spark, str(tmp_path), 700)
    assert got.count() == 5000 and got.rdd.getNumPartitions() == 8
    assert got.agg(F.sum("x")).first()[0] == pytest.approx(x.sum(), abs=5) and got.where("classification <> 2 or return_number > 3").count() == 0
    with pytest.raises(Exception, match="nothing"):
        las.read_points(spark, str(tmp_path / "nothing.las")).count()


@pytest.mark.parametrize("deflate", [True, False])
def test_gtiff_round_trip(spark, tmp_path, deflate):
    z = np.arange(12, dtype=float).reshape(3, 4)
    z[1, 2] = np.nan
    (tmp_path / "a.tif").write_bytes(gtiff.encode(z, 100.0, 200.0, 0.5, 32637, deflate=deflate))
    meta = gtiff.read_meta(spark, str(tmp_path)).first()
    assert (meta["width"], meta["height"], meta["pixel_size"], meta["x_min"], meta["y_min"], meta["epsg"], meta["nodata"]) == (4, 3, 0.5, 100.0, 200.0, 32637, -9999.0)
    got = matrix(gtiff.read_cells(spark, str(tmp_path)), "value", (3, 4))
    assert np.array_equal(got, z, equal_nan=True)
    with pytest.raises(ValueError):
        gtiff.decode(b"no tiff at all")


def test_geojson_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    rows = [(0, "mound", 0.9, "Polygon", [[{"x": x, "y": y} for x, y in ring]]), (1, "find", 0.5, "Point", [[{"x": 1.0, "y": 2.0}]])]
    schema = "feat_id long, cls string, score double, geom_type string, rings array<array<struct<x:double,y:double>>>"
    for given in (rows, []):
        geojson.write(spark.createDataFrame(given, schema), str(tmp_path / "out"))
        (part,) = (p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
        doc = json.loads(part.read_text())
        assert len(doc["features"]) == len(given) and doc["crs"]["properties"]["name"] == "EPSG:3857"
        if given:
            shell = doc["features"][0]["geometry"]["coordinates"][0]
            assert shell[0] == shell[-1] and len(shell) == 5 and polygons.ring_area(np.array(shell[:-1])) > 0
            back = geojson.read(spark, str(part)).orderBy("feat_id").collect()
            assert [(r["cls"], r["score"], r["geom_type"], r["crs"]) for r in back] == [("mound", 0.9, "Polygon", "epsg:3857"), ("find", 0.5, "Point", "epsg:3857")]
            assert len(back[0]["rings"][0]) == 4
    bad = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": None}, {"type": "Feature", "properties": {"class": "a"}, "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4, 5]]}}]}
    (tmp_path / "b.json").write_text(json.dumps(bad))
    assert geojson.read(spark, str(tmp_path / "b.json")).count() == 2
    bad["features"][1]["properties"] = {}
    (tmp_path / "c.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="a feature has no class"):
        geojson.read(spark, str(tmp_path / "c.json")).collect()


def test_layer_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert pipelines.cached_layer(spark, str(tmp_path), "dtm", {"a": 1, "b": 2}, Grid(), make).count() == 3
    assert len(made) == 1
    key = pipelines.layer_key("dtm", {"b": 2, "a": 1}, Grid())
    assert key == pipelines.layer_key("dtm", {"a": 1, "b": 2}, Grid()) and key != pipelines.layer_key("dtm", {"a": 1, "b": 3}, Grid())


def test_streamed_cells_equal_batch(spark, tmp_path):
    r = np.random.default_rng(6)
    pts = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in r.uniform(0, 9, (300, 3))], stream.POINTS)
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.cell_totals(stream.point_stream(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName("cell_totals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(x["row"], x["col"]): (x["n"], round(x["mean_z"], 9)) for x in spark.table("cell_totals").collect()}
    assert got == {(x["row"], x["col"]): (x["n"], round(x["mean_z"], 9)) for x in stream.cell_totals(pts).collect()}


def test_streamed_events_close_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    live = stream.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", "1 hour")
    q = live.writeStream.outputMode("append").format("memory").queryName("event_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    seen = {(r["start"], r["event_type"]): r["n"] for r in spark.table("event_counts").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n").collect()}
    assert seen and all(want[k] == n for k, n in seen.items())


def test_entry_without_training_data_part():
    code = "import sys\nsys.modules['geostrata.llm'] = None\nimport __spark_entry__ as e\nassert 'cloud_features' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).returncode == 0


def tiff(values, predictor=1, tile=None, apart=False):
    """A deflate file of bands (bands, height, width), row 0 north, written block by block."""
    import struct
    import zlib

    bands, height, width = values.shape
    wide, tall = tile or (width, 3)
    blocks = []
    for group in ([values[b : b + 1] for b in range(bands)] if apart else [values]):
        for top in range(0, height, tall):
            for left in range(0, width, wide):
                part = np.zeros((tall if tile else min(tall, height - top), wide, len(group)), values.dtype)
                cut = group[:, top : top + tall, left : left + wide].transpose(1, 2, 0)
                part[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part.dtype.type(0))
                raw = part.tobytes()
                if predictor == 3:
                    rows = np.frombuffer(part.astype(part.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(part), -1, part.dtype.itemsize)
                    planes = rows.transpose(0, 2, 1).reshape(len(part), -1, len(group))
                    raw = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
                blocks.append(zlib.compress(raw))
    starts = np.cumsum([8] + [len(b) for b in blocks])
    code = {"f": 3, "i": 2, "u": 1}[values.dtype.kind]
    bits = values.dtype.itemsize * 8
    place = [(322, 4, (wide,)), (323, 4, (tall,)), (324, 4, starts[:-1]), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, starts[:-1]), (278, 4, (tall,)), (279, 4, [len(b) for b in blocks])]
    entries = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (bits,) * bands), (259, 3, (8,)), (277, 3, (bands,)), (284, 3, (2 if apart else 1,)), (317, 3, (predictor,)), (339, 3, (code,) * bands), (33550, 12, (2.0, 2.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 10.0, 100.0, 0.0)), *place]
    start, table, extra = int(starts[-1]), b"", b""
    at = start + 2 + 12 * len(entries) + 4
    for tag, kind, vals in sorted(entries, key=lambda e: e[0]):
        data = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(vals), *vals)
        table += struct.pack("<HHI", tag, kind, len(vals)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(extra)))
        extra += data if len(data) > 4 else b""
    return b"II*\0" + struct.pack("<I", start) + b"".join(blocks) + struct.pack("<H", len(entries)) + table + b"\0\0\0\0" + extra


@pytest.mark.parametrize("kind,predictor", [("u1", 1), ("i2", 2), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("apart", [False, True])
def test_bands_tiles_and_predictors(kind, predictor, tile, apart):
    values = (np.random.default_rng(5).random((3, 20, 37)) * 200).astype(kind)
    raw = tiff(values, predictor, tile, apart)
    for band in (1, 2, 3):
        got, meta = gtiff.decode(raw, band)
        assert np.array_equal(got, values[band - 1][::-1]) and (meta["x_min"], meta["y_min"], meta["pixel_size"]) == (10.0, 60.0, 2.0)
    with pytest.raises(ValueError):
        gtiff.decode(raw, 4)


def test_collections_merge_and_show_errors(spark, tmp_path):
    preds = objects(spark, [(10, 5.0, 5.0, 2.0, 0, 0.6), (11, 5.1, 5.0, 2.0, 0, 0.9), (12, 50.0, 5.0, 2.0, 1, 0.3)])
    gts = objects(spark, [(1, 5.0, 5.0, 2.0, 0), (2, 80.0, 5.0, 2.0, 0)], False)
    rows = preds.select(F.col("id").alias("feat_id"), F.col("cls").cast("string").alias("cls"), "score", "geom_type", "rings")
    geojson.write(rows, f"{tmp_path}/many", files=3)
    docs = [json.loads("".join(r["value"] for r in spark.read.text(f, wholetext=True).collect())) for f in spark.read.text(f"{tmp_path}/many").inputFiles()]
    assert len(docs) == 3 and sum(len(d["features"]) for d in docs) == 3
    geojson.write(rows.limit(0), f"{tmp_path}/none")
    geojson.merge(spark, [f"{tmp_path}/many", f"{tmp_path}/none", f"{tmp_path}/many"], f"{tmp_path}/all")
    assert sorted(r["score"] for r in geojson.read(spark, f"{tmp_path}/all").collect()) == [0.3, 0.3, 0.6, 0.6, 0.9, 0.9]
    geojson.write_errors(matching.errors(preds, gts, matching.match(preds, gts)), preds, gts, f"{tmp_path}/errors")
    doc = json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/errors", wholetext=True).collect()))
    assert {(f["properties"]["kind"], f["properties"]["error"]) for f in doc["features"]} == {("FP", "duplicate"), ("FP", "background"), ("FN", "missed")}


def test_points_through_spark(spark, tmp_path):
    x = np.arange(250) * 0.5
    las.write(f"{tmp_path}/a.las", x, x + 1, x * 2, intensity=7, return_number=2, classification=2)
    split = las.read_points(spark, str(tmp_path / "a.las"), records=100)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a.las").select("path", "content").mapInArrow(las._through_spark, las.SCHEMA)
    assert split.drop("path").exceptAll(files.drop("path")).count() == 0 and files.count() == 250
    assert las.read_points(spark, str(tmp_path / "a.las"), z_unit="feet", max_points=9).count() == 9
    with pytest.raises(ValueError):
        las.read_points(spark, str(tmp_path), z_unit="yards")
