"""Sites to tiles of fixed size: padding, validity, channels, targets, draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.model import SiteGrids
from geostrata.operators.rasters import axis_starts
from geostrata.plans.dataset import draw, load_sites, site_facts, tiles

SIZES = {"a": (20, 27), "b": (5, 6), "c": (9, 30)}


@pytest.fixture(scope="module")
def sites(spark):
    grids = SiteGrids(spark.createDataFrame([(s, 0.0, 0.0, 1.0, w, h) for s, (h, w) in SIZES.items()], "site string, x_min double, y_min double, pixel_size double, width int, height int"))
    rows = [(s, "slope", i, j, float(i * 100 + j)) for s, (h, w) in SIZES.items() for i in range(h) for j in range(w)]
    rows += [("a", "dtm", i, j, float(i)) for i in range(20) for j in range(27) if j < 10]
    rows += [("b", "dtm", 2, 2, float("nan")), ("b", "dtm", 2, 3, None), ("b", "dtm", 0, 0, 7.0), ("a", "other", 0, 0, 1.0), ("b", "slope", 99, 99, 1.0)]
    return spark.createDataFrame(rows, "site string, layer string, row int, col int, value double"), grids


def test_arrays_equal_windows(spark, sites):
    layers, grids = sites
    square = [{"x": x, "y": y} for x, y in ((1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0))]
    objects = spark.createDataFrame([("a", 1, "m", "Polygon", [square]), ("a", 2, "n", "Point", [[{"x": 25.5, "y": 18.5}]]), ("a", 3, "unknown", "Point", [square[:1]])], "site string, id long, cls string, geom_type string, rings array<array<struct<x:double,y:double>>>")
    pixels = load_sites(layers, grids, ["slope", "dtm", "gone"], objects, ["m", "n"], 1.0, robust=False)
    assert pixels.count() == sum(h * w for h, w in SIZES.values())
    got = tiles(pixels, grids, 8, 3).collect()
    windows = {(s, r, c) for s, (h, w) in SIZES.items() for r in axis_starts(h, 8, 5) for c in axis_starts(w, 8, 5)}
    assert {(t.site, t.row0, t.col0) for t in got} == windows and len(got) == len(windows)
    for t in got:
        h, w = SIZES[t.site]
        assert (t.h, t.w) == (min(8, h), min(8, w)) and len(t.x) == len(t.valid) == len(t.seg) == len(t.hm) == 64
        for k in range(64):
            i, j = t.row0 + k // 8, t.col0 + k % 8
            inside = i < h and j < w
            assert t.x[k][0] == (i * 100 + j if inside else 0) and t.x[k][2] == 0
            near = {"a": j < 17, "b": i * i + j * j <= 49, "c": True}[t.site]  # filled over seven cells; c has no such layer
            assert t.valid[k] == (inside and near)
            assert t.seg[k] == [float(t.site == "a" and 1 <= i < 4 and 1 <= j < 4), 0.0]
        bump = t.site == "a" and t.row0 <= 18 < t.row0 + 8 and t.col0 <= 25 < t.col0 + 8
        assert t.positive == (any(s[0] > 0 for s in t.seg) or bump or any(v >= 0.5 for p in t.hm for v in p))
        assert any(p[1] == 1.0 for p in t.hm) == bump
    assert tiles(load_sites(layers.limit(0), grids, ["slope"]), grids, 8, 0).where("positive is not null").count() == 0
    assert load_sites(layers.limit(0), grids, ["slope"]).where("valid and x[0] = 0").count() == pixels.count()


def test_scaled_channels_and_facts(spark, sites):
    layers, grids = sites
    found = {(r.row, r.col): r.x[0] for r in load_sites(layers, grids, ["slope"]).where("site = 'c'").collect()}
    values = np.array([i * 100 + j for i in range(9) for j in range(30)], float)
    low, mid, high = np.percentile(values, (2, 50, 98))
    assert all(v == pytest.approx(np.clip((i * 100 + j - mid) / (high - low), -8, 8)) for (i, j), v in found.items())
    folders = spark.createDataFrame([("a", "07_"), ("b", "01_")], "site string, code string")
    facts = {r.site: (r.present, r.observed) for r in site_facts(layers, grids, ["dtm", "gone", "slope"], folders, ["finds", "mound"], {"finds": ["07_"]}).collect()}
    assert facts == {"a": ([True, False, True], [True, True]), "b": ([True, False, True], [False, True]), "c": ([False, False, True], [True, True])}
    with pytest.raises(ValueError):
        load_sites(layers, grids, ["slope", "slope"])
    with pytest.raises(ValueError):
        tiles(load_sites(layers, grids, ["slope"]), grids, 8, 8)


def test_draws(spark):
    items = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.col("id").cast("int").alias("row0"), F.lit(0).alias("col0"), (F.col("id") % 20 == 0).alias("positive"))
    got = draw(items, 4000, 0.5, [0, 1], 7).cache()
    rows = got.collect()
    assert len(rows) == 8000 and {(r.epoch, r.draw) for r in rows} == {(e, k) for e in (0, 1) for k in range(4000)}
    for epoch in (0, 1):
        mine = [r for r in rows if r.epoch == epoch]
        assert abs(sum(r.positive for r in mine) / 4000 - 0.5) < 0.04
        counts = np.bincount([r.row0 for r in mine], minlength=500)
        assert counts[::20].min() > 40 and counts[::20].max() < 130  # 80 each on average
    assert rows and sorted(map(tuple, draw(items.repartition(7), 4000, 0.5, [0, 1], 7).collect())) == sorted(map(tuple, rows))
    assert {r.row0 for r in rows if r.epoch == 0} != {r.row0 for r in rows if r.epoch == 1}
    got.unpersist()
    one = draw(items.where("positive"), 50, 0.5, [3], 1)
    assert one.count() == 50 and one.where("not positive").count() == 0
    assert draw(items.limit(0), 50, 0.5, [0], 1).count() == 0 and draw(items, 0, 0.5, [0], 1).count() == 0
    with pytest.raises(ValueError):
        draw(items, 5, 1.0, [0], 1)
