"""Objects that are copies of few kinds: results by brute force, work by kinds instead of pairs."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.functions import copies
from geostrata.functions import polygons as kernels
from geostrata.operators import matching, rasters
from geostrata.operators.geometry import squares

N_DETS, N_GTS = 40, 25


def objects(spark, rows, keys="", score=True):
    """Squares (id, cx, cy, half, cls, score) as objects."""
    out = spark.createDataFrame(rows, f"{keys}id long, cx double, cy double, half double, cls long, score double").repartition(3)
    return squares(out if score else out.drop("score")).withColumn("geom_type", F.lit("Polygon"))


@pytest.fixture
def overlaps(spark, monkeypatch):
    """Counts the overlaps that are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def polygon_iou(a, b):
        @F.pandas_udf("double")
        def run(left: pd.Series, right: pd.Series) -> pd.Series:
            seen.add(int((left.notna() & right.notna()).sum()))
            arrays = lambda rings: [pd.DataFrame([(p["x"], p["y"]) for p in ring]).to_numpy() for ring in rings]
            return pd.Series([0.0 if p is None or q is None else kernels.iou(arrays(p), arrays(q)) for p, q in zip(left, right, strict=True)], dtype=float)

        return run(a, b)

    monkeypatch.setattr(matching, "polygon_iou", polygon_iou)
    return seen


def scene(seed):
    rng = random.Random(seed)
    dets = [(i, 10.0 * (i % 2), 0.1 * (i % 3), 2.0, 0, rng.choice([0.1, 0.5, 0.9])) for i in rng.sample(range(1 << 60), N_DETS)]
    gts = [(i, 10.0 * (i % 2), 0.1 * (i % 4), 2.0, 0, 0.0) for i in rng.sample(range(1 << 60), N_GTS)]
    return dets, gts


def iou(a, b):
    side = lambda k: max(0.0, min(a[k] + a[3], b[k] + b[3]) - max(a[k] - a[3], b[k] - b[3]))
    both = side(1) * side(2)
    return round(both / (4 * a[3] ** 2 + 4 * b[3] ** 2 - both), 9)


def greedy(dets, gts, threshold=0.5):
    free, found = list(gts), set()
    for d in sorted(dets, key=lambda d: (-d[5], d[0])):
        best = min((g for g in free if iou(d, g) >= threshold), key=lambda g: (-iou(d, g), g[0]), default=None)
        if best:
            free.remove(best)
            found.add((d[0], best[0]))
    return found


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_match_of_copies(spark, monkeypatch, overlaps, most):
    """Ids beyond 2^53; equal qualities of two kinds go to the smaller truth; the kinds' overlaps suffice."""
    monkeypatch.setattr(matching, "ORDER_ROWS", most, raising=False)
    dets, gts = scene(1)
    found = matching.match(objects(spark, dets), objects(spark, gts, score=False))
    assert {(r.id, r.gt_id) for r in found.collect()} == greedy(dets, gts)
    assert 0 < overlaps.value <= 2 * 3 * 4 * 2


def test_errors_of_copies(spark, overlaps):
    """Copies of a matched detection are duplicates, found by the overlaps of kinds."""
    dets = [(i, 0.0, 0.0, 2.0, 0, 0.5) for i in range(30)] + [(i, 1.9, 0.0, 2.0, 0, 0.1) for i in range(30, 60)]
    gts = [(i, 0.0, 0.0, 2.0, 0, 0.0) for i in range(2)] + [(9, 50.0, 50.0, 2.0, 0, 0.0)]
    preds, truths = objects(spark, dets), objects(spark, gts, score=False)
    pairs = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 0, 1.0)], "id long, gt_id long, cls long, quality double")
    got = {(r.kind, r.id): r.error for r in matching.errors(preds, truths, pairs).collect()}
    want = {("FP", i): "duplicate" if i < 30 else "localization" for i in range(2, 60)} | {("FN", 9): "missed"}
    assert got == want and overlaps.value <= 20


def test_nms_and_conflicts_of_copies(spark, monkeypatch):
    """The first of a place stands for it; without numbers nothing is dropped; conflicts list every pair."""
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(4)), 0.0, 0, rng.choice([0.1, 0.5])) for i in rng.sample(range(1 << 60), 60)]
    dets = spark.createDataFrame([*rows, (5, None, 0.0, 0, 0.9), (6, 0.0, 0.0, 0, None)], "id long, cx double, cy double, cls int, score double")
    ahead = lambda a, b: (-a[4], a[0]) < (-b[4], b[0])
    want = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if abs(a[1] - b[1]) <= 1 and ahead(a, b)}
    assert {(r.id, r.other) for r in matching.conflicts(dets, 1.0).collect()} == want
    kept: list = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if not any((k[0], r[0]) in want for k in kept):
            kept.append(r)
    seen, real = [], matching.conflicts
    monkeypatch.setattr(matching, "conflicts", lambda given, *a: (seen.append(given.count()), real(given, *a))[1])
    assert {r.id for r in matching.nms(dets, 1.0).collect()} == {k[0] for k in kept} | {5, 6}
    assert seen == [4]


def test_spectral_query_of_constant_bands(spark, tmp_path):
    """Every cell's highest return is the same: the query keeps its columns."""
    rows = [(i, 1, 1, 1, 1000.0 * i + 1, 50.0, 0.01 * (i % 3), "A", "O") for i in range(20)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = rasters.q_spectral(spark, str(tmp_path)).collect()
    assert len(found) == 20 and all(r.ndvi == 0 and r.sr == 1 for r in found)


def test_match_of_copies_at_sites(spark, overlaps):
    """Sites with the same ids and shapes stay apart."""
    dets, gts = scene(2)
    site = lambda rows, s: [(s, *r) for r in rows]
    few = gts[:10]
    preds, truths = objects(spark, site(dets, "a") + site(dets, "b"), "site string, "), objects(spark, site(gts, "a") + site(few, "b"), "site string, ", False)
    got = {(r.site, r.id, r.gt_id) for r in matching.match(preds, truths, keys=("site",)).collect()}
    assert got == {("a", *p) for p in greedy(dets, gts)} | {("b", *p) for p in greedy(dets, few)}
    assert 0 < overlaps.value <= 100


def test_match_leaves_other_classes_out(spark, overlaps):
    """Overlaps with truths of other classes are not worked out; without classes they are."""
    dets = [(i, 0.0, 0.0, 2.0, 0, 0.5) for i in range(4)]
    gts = [(1, 0.0, 0.0, 2.0, 0, 0.0), *((c + 1, 0.0, 0.0, 2.0, c, 0.0) for c in range(1, 6))]
    preds, truths = objects(spark, dets), objects(spark, gts, score=False)
    assert [(r.id, r.gt_id) for r in matching.match(preds, truths).collect()] == [(0, 1)]
    assert overlaps.value == 1
    assert {(r.id, r.gt_id) for r in matching.match(preds, truths, class_agnostic=True).collect()} == {(0, 1), (1, 2), (2, 4), (3, 5)}  # class 2 has a hole
    assert overlaps.value > 1


def test_kinds_of_one_hash_stay_apart(spark):
    """A null is skipped by the hash, so these two kinds share it."""
    rows = spark.createDataFrame([(1, None, 10), (None, 1, 20), (1, None, 11)], "a long, b long, id long")
    assert rows.select(F.xxhash64("a", "b")).distinct().count() == 1
    found, own = copies.named(rows, ["a", "b"], ["id"])
    assert {(r.a, r.b, r.id) for r in found.join(own, "kind").collect()} == {(1, None, 10), (None, 1, 20), (1, None, 11)}
    assert found.count() == found.select("kind").distinct().count() == 2
    found, blocks = copies.kinds(rows, ["a", "b"], ["id"])
    assert {(r.a, tuple(sorted(m.id for m in r.members))) for r in found.join(blocks, "kind").collect()} == {(1, (10, 11)), (None, (20,))}


def test_overlaps_worked_out_together():
    """The same as one by one: holes, both orientations, equal polygons, edges in common, many edges, no area, no number."""
    rng = np.random.default_rng(3)

    def polygon(k):
        at, half = np.round(rng.uniform(0, 4, 2) * 2) / 2, rng.choice([0.5, 1.0, 2.0])
        if k == 0:
            square = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * half
            return [square[:: rng.choice([1, -1])] + at, square * 0.2 + at][: rng.choice([1, 2])]
        turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 60 if k == 2 else 9)))
        return [np.stack((np.cos(turn), np.sin(turn)), 1) * half * rng.uniform(0.4, 1, (len(turn), 1)) + at + 1e6 * (k == 1)]

    pairs = [(polygon(k % 3), polygon(k // 3 % 3)) for k in range(450)]
    pairs += [(a, a) for a, _ in pairs[:30]] + [([np.zeros((3, 2))], pairs[0][1]), ([np.full((3, 2), np.nan)], pairs[0][1])]
    sides = [([np.concatenate(p[s])[:, 0] for p in pairs], [np.concatenate(p[s])[:, 1] for p in pairs], [[len(r) for r in p[s]] for p in pairs]) for s in (0, 1)]
    want = np.array([kernels.iou(a, b) for a, b in pairs])
    assert (want > 0).sum() > 50
    np.testing.assert_allclose(kernels.ious(*sides), want, atol=1e-12)


def test_evaluate_matches_once(spark):
    """The matches are read for hits, false alarms and misses, but worked out once."""
    seen = spark.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    schema = "site string, id long, cls long"
    preds, truths = (spark.createDataFrame([(s, i, 0) for s in "ab" for i in range(n)], schema) for n in (5, 3))
    pairs = spark.createDataFrame([(s, i, i, 0) for s in "ab" for i in range(2)], "site string, id long, gt_id long, cls long").mapInPandas(run, "site string, id long, gt_id long, cls long")
    got = matching.evaluate(preds, truths, pairs, ("site",)).where("cls = 0").collect()
    assert {(r.site, r.tp, r.fp, r.fn) for r in got} == {("a", 2, 3, 1), ("b", 2, 3, 1)}
    assert seen.value == 4
