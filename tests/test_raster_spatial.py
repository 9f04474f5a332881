"""Rasterisation, clipping, masks and scalar geometry."""

import random

import pytest
from pyspark.sql import functions as F

from catchment.functions import directions, geometry
from catchment.operators import evaluate, masks, raster, spatial

SEG = "grid_id string, feature_id long, part int, seg int, x0 double, y0 double, x1 double, y1 double, start_h double, end_h double"


def box(*v):
    return tuple(F.lit(float(x)) for x in v)


def walk(a, b, flat):
    """Incremental integer line with bridged diagonals."""
    (r0, c0), (r1, c1) = a, b
    dr, dc, sr, sc = abs(r1 - r0), abs(c1 - c0), 1 if r1 > r0 else -1, 1 if c1 > c0 else -1
    out, r, c = [(r0, c0)], r0, c0
    err = max(dr, dc) / 2
    while (r, c) != (r1, c1):
        pr, pc = r, c
        if dc >= dr:
            c, err = c + sc, err - dr
            if err < 0:
                r, err = r + sr, err + dc
        else:
            r, err = r + sr, err - dc
            if err < 0:
                c, err = c + sc, err + dr
        if r != pr and c != pc:
            out.append((pr, c) if flat else (r, pc))
        out.append((r, c))
    return out


def test_lines_match_increments(spark):
    rng = random.Random(1)
    rows = [(i, *(rng.randrange(20) for _ in range(4)), float(rng.randint(-3, 3)), float(rng.randint(-3, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, r0 int, c0 int, r1 int, c1 int, dx double, dy double")
    got = df.select("i", raster.line_cells(*[F.col(c) for c in ("r0", "c0", "r1", "c1", "dx", "dy")]).alias("p"))
    for x in got.collect():
        _, r0, c0, r1, c1, dx, dy = rows[x.i]
        assert [tuple(p) for p in x.p] == walk((r0, c0), (r1, c1), abs(dx) >= abs(dy))


def test_height_reverses(spark):
    s = spark.createDataFrame([("g", 1, 0, 0, 0.0, 5.0, 10.0, 5.0, 1.0, 2.0)], SEG)
    assert {x.d for x in raster.rasterise(s, 10, 10, box(0, 0, 10, 10)).collect()} == {3}


def test_diagonal_is_connected(spark):
    s = spark.createDataFrame([("g", 1, 0, 0, 0.0, 10.0, 10.0, 0.0, None, None)], SEG)
    path = raster.segment_paths(s, 10, 10, box(0, 0, 10, 10)).first().path
    assert len(path) > 10 and all(abs(a.r - b.r) + abs(a.c - b.c) == 1 for a, b in zip(path, path[1:]))


def test_slope(spark):
    s = spark.createDataFrame([("g", 1, 0, 0, 0.0, 0.0, 10.0, 10.0, 10.0, 9.0)], SEG)
    cells = raster.slope_cells(s, 10, 10, box(0, 0, 10, 10)).collect()
    assert cells and all(x.slope == pytest.approx(1 / 200**0.5) for x in cells)


def square(i, lo, hi, ring=0):
    p = [(lo, lo), (hi, lo), (hi, hi), (lo, hi)]
    return [(i, ring, k, *map(float, (*p[k], *p[(k + 1) % 4]))) for k in range(4)]


RING = "feature_id int, ring int, edge int, x0 double, y0 double, x1 double, y1 double"


def test_clip_with_hole(spark):
    s = spark.createDataFrame([("g", 1, 0, 0, -5.0, 5.0, 15.0, 5.0, None, None)], SEG)
    rings = spark.createDataFrame(square(0, 0, 10) + square(0, 4, 6, 1), RING)
    got = sorted((round(x.x0, 6), round(x.x1, 6)) for x in spatial.clip_segments(s, rings).collect())
    assert got == [(0.0, 4.0), (6.0, 10.0)]


def test_smallest_polygon_wins(spark):
    rings = spark.createDataFrame(square(0, 0, 20) + square(1, 4, 8), RING)
    points = spark.createDataFrame([(1, 6.0, 6.0), (2, 2.0, 2.0), (3, 30.0, 30.0)], "point_id int, x double, y double")
    assert {(x.point_id, x.feature_id) for x in spatial.smallest_feature(points, rings).collect()} == {(1, 1), (2, 0)}


def test_basin_with_hole(spark):
    rings = spark.createDataFrame(square(0, 0, 5) + square(0, 2, 3, 1), RING)
    grid = spark.createDataFrame([("g", 5, 5, 0.0, 0.0, 5.0, 5.0)], "grid_id string, rows int, cols int, xmin double, ymin double, xmax double, ymax double")
    cells = {(x.r, x.c) for x in spatial.basin_mask(rings, grid).collect()}
    assert len(cells) == 24 and (2, 2) not in cells


def test_trim(spark):
    cells = spark.createDataFrame([("g", 2, 3, 1), ("g", 4, 6, 1)], "grid_id string, r int, c int, d int")
    grids = spark.createDataFrame([("g", 8, 10)], "grid_id string, rows int, cols int")
    assert tuple(masks.trim_bounds(cells, grids).first())[1:] == (1, 6, 2, 8)


def test_metrics_hand_case(spark):
    mk = lambda m: spark.createDataFrame([("g", r, c, d) for r, line in enumerate(m) for c, d in enumerate(line)], "grid_id string, r int, c int, d int")
    gold, pred = mk([[1, 2, 0], [0, 3, 4]]), mk([[1, 3, 1], [0, 0, 4]])
    m = evaluate.metrics(evaluate.aligned(pred, gold, gold)).first()
    assert (m.tp, m.fp, m.fn) == (3, 1, 1) and m.precision == m.recall == 0.75 and m.strict_recall == 0.5
    few = evaluate.metrics(evaluate.aligned(pred, gold, gold.where("r = 0 AND c < 2"))).first()
    assert (few.reviewed, few.tp, few.fp, few.strict_recall) == (2, 2, 0, 0.5)


def test_upsert(spark):
    s = "grid_id string, r int, c int, d int, reviewed boolean"
    old = spark.createDataFrame([("g", 0, 0, 1, True), ("g", 1, 1, 0, False)], s)
    new = spark.createDataFrame([("g", 0, 0, 0, False), ("g", 1, 1, 4, True)], s)
    got = {(x.r, x.c): (x.d, x.reviewed) for x in evaluate.upsert(old, new, ["grid_id", "r", "c"]).collect()}
    assert got == {(0, 0): (1, True), (1, 1): (4, True)}


def test_bad_codes_raise(spark):
    good = spark.createDataFrame([(1.0,), (4.0,)], "v double").select(directions.checked_code(F.col("v")).alias("d"))
    assert [x.d for x in good.collect()] == [1, 4]
    for bad in (257.0, 1.5, -1.0, float("nan")):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(bad,)], "v double").select(directions.checked_code(F.col("v"))).collect()


def test_grid_cols_half_to_even(spark):
    row = spark.range(1).select(geometry.grid_cols(5, F.lit(1.0), F.lit(2.0)).alias("a"), geometry.grid_cols(5, F.lit(0.0), F.lit(2.0)).alias("b"), geometry.grid_cols(5, F.lit(3.0), F.lit(0.0)).alias("c")).first()
    assert tuple(row) == (2, 2, 5)


def test_vote_resolver(spark):
    votes = spark.createDataFrame([("g", 0, 0, 1, 2.0), ("g", 0, 0, 2, 2.4)], "grid_id string, r int, c int, d int, w double")
    moves = spark.createDataFrame([("g", 0, 0, 1, 3.5)], "grid_id string, r int, c int, d int, t double")
    cells = spark.createDataFrame([("g", 0, 0, 2, 1.0, 0.0, 0.0)], "grid_id string, r int, c int, objects int, axis_x double, axis_y double, axis_conf double")
    assert raster.resolve_directions(votes, moves, cells).first().d == 1
