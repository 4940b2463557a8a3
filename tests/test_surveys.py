"""Surveys, guards, losses and tiles on small tables."""

import math

from pyspark.sql import functions as F

from geostrata.model import Grid
from geostrata.operators import surveys, terrain, training
from geostrata.plans import pipelines


def test_pairs_of_any_depth(spark):
    texts = ['{"a":[1,2],"b":[[3.5,-4e1,9],[5,6]]}', '{"name":"[7,8]","q":"\\"[1,2]"}', "[]", "[1]", '["a",[1, 2]]', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, json string").select("k", surveys.numeric_pairs(F.col("json")).alias("p")).orderBy("k").collect()
    assert [[tuple(p) for p in r.p] for r in rows] == [[(1, 2), (3.5, -40), (5, 6)], [], [], [], [(1, 2)], []]


def test_site_without_labels_has_one_issue(spark):
    labels = spark.createDataFrame([("a", "mound", None, 5e6, 5e6)], "site string, cls string, file_cls string, x double, y double")
    sources = spark.createDataFrame([("a", "mound", 1), ("b", "pit", 3)], "site string, cls string, n int")
    found = surveys.site_issues(labels, sources, ["mound", "pit"], (0, 0, 1e7, 1e7)).collect()
    assert [tuple(r) for r in found] == [("b", "error", "no labels", 3)]
    assert surveys.site_issues(labels.limit(0), sources.limit(0), [], (0, 0, 1, 1)).count() == 0


def test_survey_of_an_empty_listing(spark):
    none = spark.createDataFrame([], "site string, folder string, name string, bytes long")
    assert surveys.survey(none).count() == 0
    assert tuple(surveys.survey_totals(surveys.survey(none)).first()) == (0,) * 8


def test_fill_stops_at_the_distance(spark):
    cells = spark.range(12).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.when(F.col("id") == 0, 3.0).alias("z"))
    assert [r.z for r in terrain.fill_within(cells, "z", 7.0).orderBy("col").collect()] == [3.0] * 8 + [None] * 4


def test_masked_loss_leaves_out_what_was_not_observed(spark):
    shape = "cls string, seg double, hm double, y_seg int, y_hm double, valid boolean, observed int"
    seen = [("a", 0.0, 0.0, 1, 0.5, True, 1), ("a", 800.0, -800.0, 1, 0.0, True, 1)]
    unseen = [("a", -9.0, 9.0, 1, 1.0, False, 1), ("b", 9.0, 9.0, 0, 0.0, True, 0)]
    one, both = (training.masked_loss(spark.createDataFrame(rows, shape)).first() for rows in (seen, seen + unseen))
    assert tuple(one) == tuple(both)
    dice, focal = 1 - (2 * 1.5 + 1) / (1.5 + 2 + 1), 0.25 * 0.25 * math.log(2) / 2
    assert math.isclose(one.dice, dice) and math.isclose(one.focal, focal) and one.heat == 0 and math.isclose(one.loss, dice + focal)
    assert tuple(training.masked_loss(spark.createDataFrame(unseen[1:], shape)).first()) == (0, 0, 0, 0)


def test_tiles_are_padded(spark):
    cells = spark.range(6).select((F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.when(F.col("id") != 4, F.col("id")).alias("z"), F.lit(True).alias("valid"))
    tiles = spark.createDataFrame([(0, 0, 0, 2, 3)], "tile_id int, row0 int, col0 int, h int, w int")
    found = {(r.i, r.j): (r.z, r.valid) for r in training.training_tiles(cells, tiles, 4, ["z"]).collect()}
    assert len(found) == 16 and found[1, 2] == (5, True) and found[1, 1] == (0, True) and found[3, 0] == (0, False)
    assert sum(v for _, v in found.values()) == 6


def test_layers_are_listed_and_removed(spark, tmp_path):
    root, make = str(tmp_path), lambda: spark.range(3)
    assert pipelines.list_layers(spark, root).count() == 0
    for name, a in (("dtm", 1), ("dtm", 2), ("slope", 1)):
        pipelines.cached_layer(spark, root, name, {"a": a}, Grid(), make)
    listed = pipelines.list_layers(spark, root).collect()
    assert sorted(r.layer for r in listed) == ["dtm", "dtm", "slope"] and all(r.bytes > 0 for r in listed)
    assert pipelines.invalidate(spark, root, "dtm") == 2 and [r.layer for r in pipelines.list_layers(spark, root).collect()] == ["slope"]
    assert pipelines.invalidate(spark, root) == 1 and pipelines.invalidate(spark, root) == 0


def test_grids_differ_by_more_than_the_tolerance(spark):
    grid = lambda x, crs: F.struct(F.lit(crs).alias("crs"), F.lit(1.0).alias("pixel_size"), F.lit(x).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(3).alias("width"), F.lit(4).alias("height"))
    row = spark.range(1).select(*(surveys.grids_equal(grid(0.0, "a"), grid(x, crs)) for x, crs in ((5e-7, "a"), (2e-6, "a"), (0.0, "b")))).first()
    assert list(row) == [True, False, False]
