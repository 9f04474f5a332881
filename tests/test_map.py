"""Layers of a map in one plan: systems in columns against one transform at a time, choices, states, clips."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from catchment.operators import crs, crs_job, suppression

LAYERS = "layer string, kind string, ord int, crs string, prj_error string, assigned string"
LINES = "layer string, feature_id long, part int, seg int, x0 double, y0 double, x1 double, y1 double"
CHOICES = "layer string, key string, ord int"


def test_systems_in_columns(spark):
    """All 49 pairs of systems in one frame."""
    rng = random.Random(3)
    degrees = [(k, rng.uniform(126.2, 128.8), rng.uniform(34.5, 38.5)) for k in range(4)]
    points = spark.createDataFrame(degrees, "k int, x double, y double")
    parts = []
    for a, b in itertools.product(crs.SYSTEMS.values(), repeat=2):
        one = crs.transform(points, crs.SYSTEMS["epsg4326"], a)
        parts.append([(a.key, b.key, r.k, r.x, r.y, w.x, w.y) for r, w in zip(one.orderBy("k").collect(), crs.transform(one, a, b).orderBy("k").collect())] if a.key in ("epsg5174", "epsg5179", "epsg4326") else [])
    rows = [r for p in parts for r in p]
    frame = spark.createDataFrame(rows, "a string, b string, k int, x double, y double, wx double, wy double")
    for r in crs_job.transform(frame, "a", "b", ("x", "y")).collect():
        assert abs(r.x - r.wx) < 1e-6 and abs(r.y - r.wy) < 1e-6, r
    odd = spark.createDataFrame([(None, "epsg5179", 1.0, 2.0), ("epsg1", "epsg5179", 1.0, 2.0), ("epsg1", "epsg1", 1.0, 2.0)], "a string, b string, x double, y double")
    assert [(r.x, r.y) for r in crs_job.transform(odd, "a", "b", ("x", "y")).collect()] == [(None, None), (None, None), (1.0, 2.0)]


def job(spark, layers, lines, choices=(), project=None):
    return crs_job.prepared(spark.createDataFrame(layers, LAYERS), spark.createDataFrame(lines, LINES), spark.createDataFrame(list(choices), CHOICES), project)


def test_first_choice_sets_the_project(spark):
    layers = [("a", "polyline", 0, None, None, None), ("b", "boundary", 1, "epsg4326", None, None), ("c", "polyline", 2, "epsg5179", "bad", None)]
    lines = [(n, 0, 0, 0, 127.0, 38.0, 127.1, 38.1) for n in "ab"] + [("c", 0, 0, 0, 1.0, 2.0, 3.0, 4.0)]
    frames = [spark.createDataFrame(layers, LAYERS), spark.createDataFrame([], CHOICES), spark.createDataFrame([("c", "epsg5186", 5), ("a", "epsg4326", 3), ("a", "epsg5186", 9)], CHOICES)]
    assert crs_job.project_system(frames[0], frames[1]) == "epsg4326"  # of all layers only b has a system
    assert crs_job.project_system(frames[0], frames[2]) == "epsg4326"  # chosen first, though not the last
    assert crs_job.project_system(frames[0], frames[2], "epsg5181") == "epsg5181"
    states, work = job(spark, layers, lines, [("c", "epsg5186", 5), ("a", "epsg4326", 9)])
    got = {r.layer: r for r in states.collect()}
    assert [(got[n].source, got[n].project, got[n].status, got[n].ready) for n in "abc"] == [("epsg4326", "epsg5186", "reprojected", True)] * 2 + [("epsg5186", "epsg5186", "native", True)]
    assert abs(got["a"].ymin - 600_000) < 1e-6 and got["c"].xmax == 3.0 and work.count() == 3
    states, _ = job(spark, layers, lines)
    assert {r.layer: (r.status, r.ready) for r in states.collect()} == {"a": ("unassigned", False), "b": ("native", True), "c": ("invalid", False)}


def test_errors_are_rows(spark):
    layers = [("a", "polyline", 0, "epsg4326", None, None), ("b", "image", 1, "epsg4326", None, None), ("c", "polyline", 2, "epsg77", None, None), ("d", None, 3, None, None, None), ("e", "polyline", 4, "epsg4326", None, None), ("f", "polyline", 5, "epsg4326", None, None)]
    lines = [(n, 0, 0, 0, 127.0, 38.0, 127.1, 38.1) for n in "bcdf"] + [("e", 0, 0, 0, 127.0, 95.0, float("nan"), 38.0)]
    states, work = job(spark, layers, lines, project="epsg5186")
    got = {r.layer: (r.error, r.ready) for r in states.collect()}
    assert got == {"a": ("no coordinates", False), "b": ("unsupported kind: image", False), "c": ("unknown system: epsg77", False), "d": ("unsupported kind: none", False), "e": ("a coordinate can't be transformed", False), "f": (None, True)}
    assert {r.layer for r in work.collect()} == {"f"}
    assert [tuple(crs_job.active_pipe(states, *names).first()) for names in (("f", "a"), ("b", "f"), ("b", "a"), (None, "zz"))] == [("f", None), ("f", None), ("a", "no coordinates"), (None, "no pipe layer")]
    empty, none = job(spark, [], [])
    assert empty.count() == 0 and none.count() == 0


def test_empty_clip_is_an_error_row(spark):
    layers = [("in", "polyline", 0, "epsg5186", None, None), ("out", "polyline", 1, "epsg5186", None, None), ("none", "polyline", 2, None, None, None), ("area", "boundary", 3, "epsg5186", None, None)]
    lines = [("in", 0, 0, 0, -5.0, 5.0, 15.0, 5.0), ("in", 1, 0, 0, 2.0, 2.0, 3.0, 3.0), ("out", 0, 0, 0, 20.0, 0.0, 30.0, 0.0), ("none", 0, 0, 0, 1.0, 1.0, 2.0, 2.0), ("area", 0, 0, 0, 1.0, 1.0, 2.0, 2.0)]
    states, work = job(spark, layers, lines, project="epsg5186")
    ring = [(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, 0.0)]
    rings = spark.createDataFrame([(0, 0, k, *e) for k, e in enumerate(ring)], "feature_id long, ring int, edge int, x0 double, y0 double, x1 double, y1 double")
    pieces, told = crs_job.clipped(states, work, rings)
    assert sorted((r.layer, r.x0, r.x1) for r in pieces.collect()) == [("in", 0.0, 10.0), ("in", 2.0, 3.0)]
    assert {r.layer: (r.pieces, r.error) for r in told.collect()} == {"in": (2, None), "out": (0, "no line inside the boundary"), "none": (0, "the layer has no coordinate system")}


# greedy suppression

@pytest.mark.parametrize("most", [None, 3])
def test_suppression_is_greedy(spark, most):
    rng = random.Random(12)
    rows = []
    for k in range(260):
        angle = rng.choice([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.6, 0.8), (0.0, 0.0)])
        rows.append((rng.choice(["p", "q"]), float(rng.randrange(40)), float(rng.randrange(30)), *angle, float(rng.randrange(50)), f"n{k}"))
    rows += [("p", 3.0, 3.0, 1.0, 0.0, 9.0, f"twin{k}") for k in range(60)]  # many at one place
    rows += [("r", float(k), 0.0, 1.0, 0.0, float(-k), f"chain{k}") for k in range(40)]  # each suppresses the next
    frame = spark.createDataFrame(rows, "image_id string, x double, y double, dx double, dy double, score double, name string").repartition(4)
    got = suppression.suppressed(frame, 4.0, most=most).collect()
    want = []
    for image in "pqr":
        kept = []
        for r in sorted({r[:6] for r in rows if r[0] == image and r[3] ** 2 + r[4] ** 2 > 0.7} | {r[:6] + (r[6],) for r in rows if r[0] == image and r[3] ** 2 + r[4] ** 2 <= 0.7}, key=lambda r: (-r[5], *r[1:5])):
            near = [o for o in kept if (o[1] - r[1]) ** 2 + (o[2] - r[2]) ** 2 <= 16 and o[3] * r[3] + o[4] * r[4] > 0.7]
            if not near:
                kept.append(r)
        want += [r[:6] for r in kept[:most]]
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert suppression.suppressed(frame.limit(0), 4.0).count() == 0
