"""Rasters on grids of other systems against a brute-force average, canonical grids of sites, the fill of whole rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions.distance import nearest_donors
from geostrata.model import Grid
from geostrata.operators import terrain, warp

UTM = Grid(500_000.0, 5_600_000.0, 40.0, 30, 26, "EPSG:32637")
TARGET = Grid(4_341_300.0, 6_542_300.0, 130.0, 18, 17, "EPSG:3857")


def back(spark, places):
    """Places of the target in cells of the source."""
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "k long, x double, y double")
    x, y = warp.reproject(3857, 32637, F.col("x"), F.col("y"))
    rows = df.select("k", x.alias("x"), y.alias("y")).orderBy("k").collect()
    return [((r.x - UTM.x_min) / UTM.pixel_size, (r.y - UTM.y_min) / UTM.pixel_size) for r in rows]


@pytest.mark.parametrize("method", warp.METHODS)
def test_utm_raster_on_a_mercator_grid(spark, method):
    r = np.random.default_rng(3)
    values, other = r.normal(size=(26, 30)), r.normal(size=(26, 30))
    values[r.random((26, 30)) < 0.2] = np.nan
    known = lambda v: None if np.isnan(v) else float(v)
    cells = spark.createDataFrame([("s", i, j, known(values[i, j]), float(other[i, j])) for i in range(26) for j in range(30) if i != 4], "site string, row int, col int, a double, b double")
    values[4], other[4] = np.nan, np.nan
    got = {(x.row, x.col): x for x in warp.warp(cells, UTM, TARGET, ["a", "b"], method, ("site",)).collect()}
    frame = list(itertools.product(range(17), range(18)))
    offsets = [(0, 0), (1, 0), (0, 1), (1, 1)] if method == "average" else [(0.5, 0.5)]
    places = back(spark, [(TARGET.x_min + (j + dx) * TARGET.pixel_size, TARGET.y_min + (i + dy) * TARGET.pixel_size) for i, j in frame for dx, dy in offsets])
    seen = 0
    for n, (i, j) in enumerate(frame):
        own = np.array(places[n * len(offsets) : (n + 1) * len(offsets)])
        low, high = own.min(0), own.max(0)
        if method == "bilinear":
            low, high = low - 0.5, high + 0.5
        if method == "nearest":
            low = np.floor(low)
            high = low + 1
        wx = np.clip(np.minimum(np.arange(30) + 1, high[0]) - np.maximum(np.arange(30), low[0]), 0, None)
        wy = np.clip(np.minimum(np.arange(26) + 1, high[1]) - np.maximum(np.arange(26), low[1]), 0, None)
        for name, grid in (("a", values), ("b", other)):
            w = wy[:, None] * wx[None, :] * np.isfinite(grid)
            if w.sum() > 0:
                seen += 1
                assert abs(getattr(got[i, j], name) - np.nansum(w * np.nan_to_num(grid)) / w.sum()) < 1e-6 and got[i, j].covered
            else:
                assert (i, j) not in got or getattr(got[i, j], name) is None
    assert seen > 50
    share = warp.coverage(warp.warp(cells, UTM, TARGET, ["a", "b"], method, ("site",)), TARGET, ("site",)).first().share
    assert 0 < share <= 1 and warp.warp(cells.limit(0), UTM, TARGET, ["a"], method).count() == 0


def test_unknown_method_and_system(spark):
    with pytest.raises(ValueError):
        warp.warp(spark.range(1), UTM, TARGET, ["id"], "cubic")
    with pytest.raises(ValueError):
        warp.reproject(4326, 3358, F.lit(1.0), F.lit(2.0))


def test_canonical_grid_of_a_site(spark):
    places = spark.createDataFrame([("a", 39.0, 51.0), ("a", 39.01, 51.0), ("b", -70.0, -30.0)], "site string, x double, y double")
    got = {r.site: r for r in warp.canonical_grids(places, 4326, 2.0, 10).collect()}
    a, b = got["a"], got["b"]
    assert (a.epsg, b.epsg) == (32637, 32719) and a.x_min % 2 == 0 and a.y_min % 2 == 0
    assert a.x_min <= 500_000 - 20 < a.x_min + 2 and 350 < a.width < 380 and 20 <= a.height <= 23  # 39 degrees is the zone's middle


def test_donors_of_a_row_are_the_nearest():
    r = random.Random(2)
    for _ in range(300):
        cols = sorted(r.sample(range(60), r.randrange(1, 40)))
        at = sorted(r.sample(cols, r.randrange(1, len(cols) + 1)))
        drow, row = [r.randrange(9) for _ in at], r.randrange(9)
        got = nearest_donors(np.array(cols), row, np.array(at), np.array(drow))
        assert [min(range(len(at)), key=lambda k: ((c - at[k]) ** 2 + (drow[k] - row) ** 2, drow[k], at[k])) for c in cols] == got.tolist()


def test_fill_of_a_raster_with_one_known_cell(spark):
    rows = [("b", i, j, 7.0 if (i, j) == (40, 3) else None, f"{i}x") for i in range(60) for j in range(50)] + [("c", i, 0, None, None) for i in range(3)]
    cells = spark.createDataFrame(rows, "site string, row int, col int, z double, note string")
    got = terrain.fill_nearest(cells, ["z"], ("site",))
    assert got.columns == [*cells.columns, "observed"]
    assert {(r.site, r.z, r.n, r.seen) for r in got.groupBy("site", "z").agg(F.count("*").alias("n"), F.count_if("observed").alias("seen")).collect()} == {("b", 7.0, 3000, 1), ("c", None, 3, 0)}
    assert got.where("note <> concat(row, 'x')").count() == 0
