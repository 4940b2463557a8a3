"""The nearest seeds of a pyramid, and the plan from probabilities to polygons in files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions.polygons import ring_area
from geostrata.model import SiteGrids
from geostrata.operators import quantiles, rasters
from geostrata.operators.nearest import k_nearest
from geostrata.operators.rasters import peaks
from geostrata.plans.outlines import Outlining, outline_objects, write_objects
from geostrata.sources import geojson


@pytest.mark.parametrize(("extent", "n", "m", "k", "reach"), [(12, 60, 30, 3, None), (900, 80, 40, 5, None), (90, 200, 3, 4, 20.0)])
def test_nearest_equal_all_distances(spark, extent, n, m, k, reach):
    rnd = random.Random(extent)
    cells = {(s, rnd.randrange(-extent, extent), rnd.randrange(extent)) for s in "ab" for _ in range(n)}
    seeds = {(s, rnd.randrange(-extent, extent), rnd.randrange(extent)) for s in "ac" for _ in range(m)}
    found = k_nearest(spark.createDataFrame(list(cells), "site string, row int, col int"), spark.createDataFrame(list(seeds), "site string, row int, col int"), k, ("site",), reach)
    want = {}
    for s, r, c in cells:
        near = sorted(((r - a) ** 2 + (c - b) ** 2, a, b) for site, a, b in seeds if site == s)
        if near and (reach is None or near[0][0] <= reach * reach):
            want |= {(s, r, c, i + 1): d for i, d in enumerate(near[:k])}
    assert {(x.site, x.row, x.col, x.place): (x.d2, x.srow, x.scol) for x in found.collect()} == want


def test_nearest_of_nothing_nulls_and_repeats(spark):
    some = spark.createDataFrame([(0, 0), (0, 0), (5, None), (None, None)], "row int, col int")
    assert k_nearest(some.limit(0), some).count() == 0 and k_nearest(some, some.limit(0)).count() == 0
    one = spark.createDataFrame([(3, 4)], "row int, col int")
    got = k_nearest(one, some.withColumn("v", F.monotonically_increasing_id()), 3, order=("v",)).orderBy("place").collect()
    assert [(r.d2, r.place) for r in got] == [(25, 1), (25, 2)] and got[0].v < got[1].v
    with pytest.raises(ValueError):
        k_nearest(one, one, 0)


def test_peaks_at_an_edge_stay_at_the_cell(spark):
    rows = spark.createDataFrame([(r, c, 0.9 if (r, c) == (0, 2) else 0.1) for r in range(5) for c in range(5)], "row int, col int, value double")
    assert [(p.row, p.col, p.sub_row, p.sub_col) for p in peaks(rows, 0.5, 3).collect()] == [(0, 2, 0.0, 2.0)]


CLASSES = ["mound", "pit"]


def scene(spark):
    """Site a: a ring, two discs that touch (two peaks) and a lone peak; b: a bar through a gap of the mask; c: nothing."""
    r, c = np.indices((40, 60))
    disc = lambda i, j, s: np.hypot(r - i, c - j) <= s
    seg = {("a", "mound"): disc(12, 12, 9) & ~disc(12, 12, 4) | disc(30, 20, 6) | disc(30, 31, 6), ("b", "pit"): (abs(r - 20) < 4) & (c > 5) & (c < 50)}
    bump = lambda i, j: 0.9 * np.exp(-((r - i) ** 2 + (c - j) ** 2) / 8)
    hm = {("a", "mound"): np.maximum(bump(30, 20), bump(30, 31)), ("a", "pit"): bump(10, 50)}
    zero = np.zeros((40, 60))
    rows = [(s, k, i, j, float(seg.get((s, k), zero)[i, j]) * 0.8, float(hm.get((s, k), zero)[i, j])) for s in "abc" for k in CLASSES for i in range(40) for j in range(60)]
    grids = SiteGrids(spark.createDataFrame([("a", 0.0, 0.0, 1.0, 60, 40), ("b", 1000.0, 500.0, 2.0, 60, 40), ("c", 0.0, 0.0, 1.0, 60, 40)], "site string, x_min double, y_min double, pixel_size double, width int, height int"))
    return spark.createDataFrame(rows, "site string, cls string, row int, col int, seg double, hm double"), grids


def outer(row):
    return np.array([(p["x"], p["y"]) for p in row["rings"][0]])


def test_objects_of_sites(spark, tmp_path):
    probs, grids = scene(spark)
    valid = grids.cells(spark).withColumn("valid", (F.col("site") != "b") | ~F.col("col").between(20, 30))
    found = outline_objects(probs, grids, CLASSES, Outlining(apart=3.0), valid)
    got = found.collect()
    a = [x for x in got if x.site == "a"]
    ringed = [x for x in a if len(x["rings"]) == 2]
    assert len(ringed) == 1 and abs(ring_area(outer(ringed[0]))) == pytest.approx(np.pi * 81, rel=0.1)
    # the touching discs are cut at the middle; their circles lie at the same centres, and the better of each pair stays
    high = {round(float(outer(x)[:, 0].mean()), 0) for x in a if x.cls == "mound" and len(x["rings"]) == 1}
    assert len([x for x in a if x.cls == "mound"]) == 3 and all(min(abs(v - w) for w in (20.5, 31.5)) < 2 for v in high)
    assert [(x.n_cells, round(x.score, 2)) for x in a if x.cls == "pit"] == [(None, 0.9)]
    b = [x for x in got if x.site == "b"]
    assert len(b) == 2 and all(1000 <= x <= 1120 and 500 <= y <= 580 for row in b for x, y in outer(row)) and {x.n_cells for x in b} == {7 * 14, 7 * 19}
    assert not [x for x in got if x.site == "c"]
    assert outline_objects(probs.limit(0), grids, CLASSES).count() == 0
    best = outline_objects(probs, grids, CLASSES, Outlining(apart=3.0, limit=1)).collect()
    assert sorted((x.site, round(x.score, 2)) for x in best) == [("a", 0.9), ("b", 0.8)]
    write_objects(found, grids, str(tmp_path / "out"))
    sizes = {}
    for site in "abc":
        files = list((tmp_path / "out" / f"site={site}").glob("*.txt"))
        assert len(files) == 1
        sizes[site] = len(json.loads(files[0].read_text())["features"])
    assert sizes == {"a": len(a), "b": 2, "c": 0}
    back = geojson.read(spark, str(tmp_path / "out" / "site=a")).collect()
    assert sorted(x.cls for x in back) == sorted(x.cls for x in a) and sorted(len(x["rings"]) for x in back) == sorted(len(x["rings"]) for x in a)


def test_wrong_parameters(spark):
    probs, grids = scene(spark)
    for wrong in (dict(window=4), dict(vertices=2), dict(mask_threshold=1.0), dict(limit=0)):
        with pytest.raises(ValueError):
            Outlining(**wrong)
    with pytest.raises(ValueError):
        outline_objects(probs, grids, ["a", "a"])


def test_percentiles_of_large_groups(spark, monkeypatch):
    spread = F.expr("CASE g WHEN 0 THEN pmod(xxhash64(id), 5000) / 100.0 WHEN 1 THEN 5.0 + int(id % 7 = 0) WHEN 2 THEN exp(id % 50) ELSE double('NaN') END")
    df = spark.range(40_000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 4).alias("g"), "id").withColumn("v", spread).where("g <> 2 OR id < 400")
    shares = [0.0, 0.02, 0.333, 0.5, 0.98, 1.0]
    want = {r.g: r.p for r in df.where("NOT isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect() if r.g is not None}
    for at_once in (1_000, 1_000_000):
        monkeypatch.setattr(quantiles, "AT_ONCE", at_once)
        got = {r.g: r.p for r in quantiles.percentiles(df.where("g IS NOT NULL"), ("g",), "v", shares).collect()}
        assert set(got) == set(want) == {0, 1, 2} and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    assert quantiles.percentiles(df.limit(0), ("g",), "v", shares).count() == 0 and quantiles.percentiles(df.limit(0), (), "v", shares).count() == 0


def test_stretch_of_zeros(spark):
    rows = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    assert [r.byte for r in rasters.stretch(rows, "v").collect()] == [0, 0]
