"""Masks by scanlines, greedy choices by components, evaluation of several sites, surveys of labels and valid collections."""

import json
import random

import numpy as np
import pytest

from geostrata.model import Grid, SiteGrids
from geostrata.operators import matching, surveys
from geostrata.sources import geojson, las

RINGS = "rings array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def inside(x, y, rings):
    hit = False
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1]):
            if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
                hit = not hit
    return hit


SHAPES = {
    1: [ring(*((10 + (9 if k % 2 else 3) * np.cos(k * np.pi / 5), 10 + (9 if k % 2 else 3) * np.sin(k * np.pi / 5)) for k in range(10)))],  # a star
    2: [ring((2, 2), (17.3, 2.5), (16, 18), (3, 15)), ring((6, 6), (6, 12.5), (11, 12), (11, 6)), ring((12, 3), (13, 3), (13, 4))],  # holes
    3: [ring((1, 1), (19, 19), (19, 1), (1, 19))],  # touches itself
    4: [ring((-30, 5), (50, 5.2), (50, 7.9), (-30, 8))],  # beyond the grid
    5: [ring((5.5, 5.5), (8.5, 5.5), (8.5, 8.5), (5.5, 8.5))],  # through cell centres
    6: [ring((3, 3), (4, 4))],
}


def test_masks_equal_points_in_rings(spark):
    shapes = spark.createDataFrame([(k, f"c{k}", s) for k, s in SHAPES.items()], f"id long, cls string, {RINGS}")
    grid = Grid(-1.0, 0.5, 0.5, 50, 37)
    got = {(r.cls, r.row, r.col) for r in matching.rasterize(shapes, grid).collect()}
    assert got == {(f"c{k}", i, j) for k, s in SHAPES.items() for i in range(37) for j in range(50) if k != 6 and inside(-1 + (j + 0.5) * 0.5, 0.5 + (i + 0.5) * 0.5, s)}
    assert matching.rasterize(shapes.limit(0), grid).count() == 0


def test_targets_of_sites(spark):
    sites = SiteGrids(spark.createDataFrame([("a", 0.0, 0.0, 1.0, 20, 20), ("b", 100.0, 0.0, 2.0, 5, 6)], "site string, x_min double, y_min double, pixel_size double, width int, height int"))
    rows = [("a", 1, "m", "Polygon", [ring((2, 2), (6, 2), (6, 6), (2, 6))]), ("b", 1, "m", "Point", [ring((105, 5))]), ("b", 2, "other", "Point", [ring((105, 5))])]
    got = matching.label_targets(spark.createDataFrame(rows, f"site string, id long, cls string, geom_type string, {RINGS}"), 0.5, sites, ["m"]).collect()
    assert {r.cls for r in got} == {"m"} and sum(r.seg for r in got) == 16
    peak = max((r for r in got if r.site == "b"), key=lambda r: r.hm)
    assert (peak.row, peak.col, peak.hm) == (2, 2, 1.0) and all(0 <= r.col < 5 for r in got if r.site == "b")
    with pytest.raises(ValueError):
        matching.label_targets(spark.createDataFrame(rows, f"site string, id long, cls string, geom_type string, {RINGS}"), 0.5, sites, ["m", "m"])


def greedy(rows):
    served, used, out = set(), set(), set()
    for site, det, score, gt, quality in sorted(rows, key=lambda r: (-r[2], r[1], -r[4], r[3])):
        if (site, det) not in served and (site, gt) not in used:
            served.add((site, det))
            used.add((site, gt))
            out.add((site, det, gt))
    return out


@pytest.mark.parametrize("limit", [50_000, 40, 3])
def test_settled_as_in_order(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "GROUP_PAIRS", limit)
    r = random.Random(limit)
    rows = list({(s, d, g): (s, d, ((d * 7919) % 13) / 13, g, r.random()) for s in "ab" for _ in range(60) for d in [r.randrange(60)] for g in [d + r.randrange(3)]}.values())
    pairs = spark.createDataFrame(rows, "site string, id long, score double, gt_id long, quality double")
    assert {(x.site, x.id, x.gt_id) for x in matching.settle(pairs, ("site",)).collect()} == greedy(rows)
    edges = [(s, a, b) for s in "ab" for a in range(60) for b in (a + 1, a + 2) if r.random() < 0.5]
    kept = {(s, a) for s in "ab" for a in range(62)}
    for s, a, b in sorted(edges):
        if (s, a) in kept:
            kept.discard((s, b))
    gone = {(x.site, x.id) for x in matching.suppressed(spark.createDataFrame(edges, "site string, id long, other long"), ("site",)).collect()}
    assert gone == {(s, a) for s in "ab" for a in range(62)} - kept


def test_a_long_chain_takes_few_jobs(spark):
    n = 10_000
    rows = [(d, 1 - d / n, g, 0.9 if g == d else 0.8) for d in range(n) for g in (d - 1, d)]
    pairs = spark.createDataFrame(rows, "id long, score double, gt_id long, quality double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert matching.settle(pairs).where("id = gt_id").count() == n
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 20


def test_sites_with_the_same_ids_are_told_apart(spark):
    square = lambda x: [ring((x, 0), (x + 4, 0), (x + 4, 4), (x, 4))]
    preds = spark.createDataFrame([(s, 1, "m", 0.9, "Polygon", square(0)) for s in "ab"], f"site string, id long, cls string, score double, geom_type string, {RINGS}")
    gts = spark.createDataFrame([("a", 1, "m", "Polygon", square(0)), ("b", 1, "m", "Polygon", square(50))], f"site string, id long, cls string, geom_type string, {RINGS}")
    pairs = matching.match(preds, gts, keys=("site",))
    got = {(r.site, r.cls): (r.tp, r.fp, r.fn) for r in matching.evaluate(preds, gts, pairs, ("site",)).collect()}
    assert got == {("a", "m"): (1, 0, 0), ("a", None): (1, 0, 0), ("b", "m"): (0, 1, 1), ("b", None): (0, 1, 1)}
    total = matching.evaluate(preds, gts, pairs, ("site",), pooled=True).where("cls is null").first()
    assert (total.tp, total.fp, total.fn) == (1, 1, 1)


def test_labels_without_geometry_or_class_count_as_that_alone(spark):
    labels = spark.createDataFrame([("a", "mound", None, "f", 5.0, 5e6), ("a", "mound", None, None, None, None), ("a", None, None, None, 6.0, 5e6)], "site string, cls string, file_cls string, file string, x double, y double")
    sources = spark.createDataFrame([("a", "mound", 1), ("a", None, 0)], "site string, cls string, n int")
    got = {(r.level, r.issue, r.n) for r in surveys.site_issues(labels, sources, ["mound"], (0, 0, 1e7, 1e7)).collect()}
    assert got == {("error", "no class", 1), ("warning", "no geometry", 1), ("warning", "unrecognised file", 1), ("warning", "source file without class", 1)}


def test_parts_and_null_ids_stay_valid_json(spark, tmp_path):
    many = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"class": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}] * 2}
    (tmp_path / "in.geojson").write_text(json.dumps(many))
    rows = geojson.read(spark, str(tmp_path / "in.geojson")).drop("path", "crs", "part_id")
    rows = rows.unionByName(rows.selectExpr("cast(null as int) AS feat_id", "cls", "score", "geom_type", "rings"))
    geojson.write(rows, str(tmp_path / "out"), files=2)
    docs = [json.loads(f.read_text()) for f in sorted((tmp_path / "out").glob("part-*"))]
    assert sum(len(d["features"]) for d in docs) == 8 and len(docs) == 2


def test_las_files_outside_a_box_are_not_opened(spark, tmp_path):
    for k in range(4):
        x = np.arange(10.0) + 100 * k
        las.write(str(tmp_path / f"{k}.las"), x, np.zeros(10), x)
    got = las.read_points(spark, str(tmp_path), records=4).where("x >= 205 AND x < 305")
    assert got.count() == 10 and got.rdd.getNumPartitions() == 6  # two files of three ranges
    first = las.read_points(spark, str(tmp_path), records=4, max_points=25)
    assert sorted(r.x for r in first.collect()) == [*range(10), *range(100, 110), *range(200, 205)]
    assert las.read_points(spark, str(tmp_path), max_points=0).count() == 0
