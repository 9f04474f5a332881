"""Labels, layers, engine runs, networks, traversal."""

import io
import sys

import numpy as np
from pyspark.sql import functions as F

from catchment.operators import crs, layers, learning, raster
from catchment.sources import engine, labels


def test_npz_labels(spark):
    good, old = io.BytesIO(), io.BytesIO()
    np.savez(good, matrix=np.array([[1, 0], [0, 4]]), review_mask=np.array([[1, 0], [0, 1]]))
    np.savez(old, matrix=np.array([[2]]))
    evil = io.BytesIO()
    np.savez(evil, matrix=np.array([object()], dtype=object))
    files = spark.createDataFrame([("a", bytearray(good.getvalue())), ("b", bytearray(old.getvalue())), ("c", bytearray(evil.getvalue()))], "path string, content binary")
    rows = labels.read_npz(files).collect()
    assert {(x.path, x.r, x.c, x.d) for x in rows if x.reviewed} == {("a", 0, 0, 1), ("a", 1, 1, 4)}
    assert {x.path for x in rows if x.error} == {"c"}
    assert labels.settings("{bad") == {} and labels.settings("[1]") == {} and labels.settings('{"a": 1}') == {"a": 1}


def test_companions(spark):
    names = ["d/x_width_functions.csv", "d/x_NSE.txt", "d/y_width_functions.csv", "e/z_width_functions.csv", "e/q_NSE.txt", "d/w_NSE.txt"]
    got = {x.path: x.nse for x in labels.companion(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {"d/x_width_functions.csv": "d/x_NSE.txt", "d/y_width_functions.csv": None, "e/z_width_functions.csv": "e/q_NSE.txt"}


def test_engine_rows(spark):
    grids = spark.createDataFrame([("a", "hello"), ("b", "fail")], "grid_id string, text string")
    got = {x.grid_id: (x.code, x.output) for x in engine.run(grids, [sys.executable, "-c", "import sys; t = sys.stdin.read(); print(t.upper()); sys.exit(t == 'fail')"], 60).collect()}
    assert got == {"a": (0, "HELLO\n"), "b": (1, "FAIL\n")}
    assert engine.run(grids.limit(1), ["/no/such/engine"]).first().code is None
    assert engine.answers("0.1").split() == ["0.1", "y", "y", "-4", "3", "100", "1"]


def test_layer_rules(spark):
    s = "layer string, kind string, crs string, prj_error string, assigned string, ready boolean, xmin double, ymin double, xmax double, ymax double"
    rows = [("p", "pipe", "epsg5179", None, None, True, 0.0, 0.0, 5.0, 5.0), ("q", "area", None, None, None, True, 1.0, 1.0, 9.0, 9.0), ("r", "area", "epsg5174", None, None, True, 1.0, 1.0, 2.0, 2.0), ("s", "area", None, "bad", None, False, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, s)
    assert {x.layer: x.s for x in df.select("layer", layers.status("epsg5179").alias("s")).collect()} == {"p": "native", "q": "unassigned", "r": "reprojected", "s": "invalid"}
    got = {x.area: x.verdict for x in layers.compatible(df.where("kind = 'pipe'"), df.where("kind = 'area'")).collect()}
    assert got["q"].startswith("warning") and got["r"].endswith("differ") and got["s"].startswith("error: projection")
    assert tuple(layers.reference_box(df, "r").first()) == (0.0, 0.0, 9.0, 9.0)


def test_reprojected_segments_come_back(spark):
    s = spark.createDataFrame([("g", 1, 0, 0, 127.0, 37.5, 127.1, 37.6, None, None)], "grid_id string, feature_id long, part int, seg int, x0 double, y0 double, x1 double, y1 double, start_h double, end_h double")
    there = layers.working_copy(s, "epsg4326", "epsg5186")
    back = crs.reproject(there, crs.SYSTEMS["epsg5186"], crs.SYSTEMS["epsg4326"]).first()
    assert abs(back.x0 - 127.0) < 1e-7 and abs(back.y1 - 37.6) < 1e-7


def test_network_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in rng.normal(3 * (i % 3), 0.3, 4)], int(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_id int, x array<double>, label int")
    model = learning.train_network(df, (8,), 3)
    got = {x.sample_id: x.best for x in learning.predict_network(model, df).collect()}
    assert sum(got[i] == k for i, _, k in rows) >= 80


def test_traversal_is_connected(spark):
    df = spark.createDataFrame([(1.0, 1.0, 38.0, 27.0), (35.0, 5.0, 2.0, 30.0), (5.0, 5.0, 5.0, 5.0)], "x0 double, y0 double, x1 double, y1 double")
    for x in df.select("*", raster.traversal(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 10.0, 10.0).alias("p")).collect():
        assert tuple(x.p[0]) == (x.y0 // 10, x.x0 // 10) and tuple(x.p[-1]) == (x.y1 // 10, x.x1 // 10)
        assert all(abs(a.r - b.r) + abs(a.c - b.c) == 1 for a, b in zip(x.p, x.p[1:]))


def test_reliable_context(spark):
    anchors = spark.createDataFrame([("g", 2, 2)], "grid_id string, r int, c int")
    cells = spark.createDataFrame([("g", r, c, (r + c) % 2, float(r)) for r in range(5) for c in range(5)], "grid_id string, r int, c int, d int, score double")
    got = learning.reliable_context(anchors, cells).collect()
    assert len(got) == 4 and sorted(x.d for x in got) == [0, 0, 1, 1]
