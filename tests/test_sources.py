"""File formats built byte by byte, text formats, coordinate systems, drawings, streams."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.operators import crs, imaging
from catchment.sources import shapefile, texts, workbook
from catchment.streaming import votes as streams


def shp(kind, shapes):
    body = b""
    for i, parts in enumerate(shapes):
        points = [p for part in parts for p in part]
        firsts, n = [], 0
        for part in parts:
            firsts.append(n)
            n += len(part)
        rec = struct.pack("<i4d2i", kind, 0, 0, 10, 10, len(parts), len(points)) + struct.pack(f"<{len(firsts)}i", *firsts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    return struct.pack(">i", 9994) + b"\0" * 20 + struct.pack(">i", (100 + len(body)) // 2) + struct.pack("<2i4d", 1000, kind, 0, 0, 10, 10) + b"\0" * 32 + body


def dbf(fields, rows, deleted=()):
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields)
    size = 1 + sum(w for _, w in fields)
    data = b"".join((b"*" if i in deleted else b" ") + b"".join(str(v).encode().ljust(w)[:w] for v, (_, w) in zip(row, fields)) for i, row in enumerate(rows))
    return struct.pack("<4BIHH", 3, 24, 1, 1, len(rows), 33 + len(head), size) + b"\0" * 20 + head + b"\r" + data


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_polylines_with_heights_and_deleted_rows(spark):
    points = shapefile.read_points(files(spark, ("a/x.shp", shp(3, [[[(0, 0), (5, 5), (9, 5)]], [[(1, 1), (2, 2)]]]))))
    fields = shapefile.read_fields(files(spark, ("a/x.dbf", dbf([("H0", 8), ("H1", 8)], [("2.5", "****"), ("1", "2")], deleted={1}))))
    got = shapefile.segments(shapefile.layer(points, fields), "H0", "H1").orderBy("seg").collect()
    assert [(x.x0, x.y0, x.x1, x.y1, x.start_h, x.end_h) for x in got] == [(0, 0, 5, 5, 2.5, None), (5, 5, 9, 5, 2.5, None)]


def test_truncation_and_types_are_errors(spark):
    good = shp(3, [[[(0, 0), (5, 5)]]])
    for bad in (good[:-4], good[:110], shp(1, [])):
        with pytest.raises(Exception, match="truncated|supported"):
            shapefile.read_points(files(spark, ("x.shp", bad))).collect()


def test_field_pruning_and_values(spark):
    f = files(spark, ("x.dbf", dbf([("NAME", 6), ("N", 3)], [("West", "1"), ("East", "2"), ("", "3")])))
    assert [x.value for x in shapefile.boundary_values(shapefile.read_fields(f), "NAME").collect()] == ["East", "West"]
    assert all(not x.attributes for x in shapefile.read_fields(f, ["NONE"]).collect())


def test_ring_edges_close(spark):
    points = shapefile.read_points(files(spark, ("x.shp", shp(5, [[[(0, 0), (4, 0), (4, 4)]]]))), shapefile.POLYGONS)
    assert shapefile.ring_edges(shapefile.layer(points)).count() == 3


def book(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f'<c r="{ref}"><v>{v}</v></c>' for ref, v in cells)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{body}</row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_and_errors(spark):
    rows = workbook.read_cells(files(spark, ("a.xlsx", book([("A1", 1), ("B1", "2.0"), ("B2", 0), ("AA3", 4)])), ("b.xlsx", b"no zip"), ("c.xlsx", book([("A1", 7)]))))
    got = {(x.path, x.r, x.c, x.d) for x in rows.where("error IS NULL").collect()}
    assert got == {("a.xlsx", 0, 0, 1), ("a.xlsx", 0, 1, 2), ("a.xlsx", 2, 26, 4)}
    assert {x.path for x in rows.where("error IS NOT NULL").collect()} == {"b.xlsx", "c.xlsx"}


def test_batch_summary_needs_one_sink(spark):
    rows = workbook.read_cells(files(spark, ("a.xlsx", book([("A1", 1), ("B1", 1)])), ("b.xlsx", book([("A1", 3), ("B1", 1)]))))
    got = {x.path: (x.status, x.connected) for x in workbook.basins(rows).collect()}
    assert got["a.xlsx"] == ("ok", 2) and got["b.xlsx"][0].startswith("error: 2 sinks")


def test_matrix_round_trip_and_errors(spark):
    text = "﻿2 3\n1 1\n1 0 2\n\n4 3 0\n".replace("﻿", "")
    f = spark.createDataFrame([("p", text)], "path string, text string")
    m = texts.parse_matrix(f).first()
    assert (m.rows, m.cols, m.outlet_r, m.outlet_c) == (2, 3, 0, 0) and {tuple(c) for c in m.cells} == {(0, 0, 1), (0, 2, 2), (1, 0, 4), (1, 1, 3)}
    for bad in ("2 3\n1 1\n1 0 2\n", "1 1\n1 1\n5\n", "1 1\n2 1\n1\n"):
        with pytest.raises(Exception, match="not a direction matrix"):
            texts.parse_matrix(spark.createDataFrame([("p", bad)], "path string, text string")).collect()


def test_result_nse_and_paths(spark):
    text = "x\nFinal Direction Matrix D\n1 2\n3 4\n\n9 9\n"
    got = {(x.r, x.c, x.d) for x in texts.parse_result(spark.createDataFrame([("p", text)], "path string, text string")).collect()}
    assert got == {(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)}
    nse = "k beta ok a b\n[x]\n-1 0.1 9/10 0.5 0.6\n0 1 10/10 0.7 1 2 0.8\nbad 1 2 3 4\n"
    points = texts.parse_nse(spark.createDataFrame([("p", nse)], "path string, text string"))
    assert [(x.k, x.mean_nse, x.nse_mean) for x in points.orderBy("k").collect()] == [(-1, 0.5, 0.6), (0, 0.7, 0.8)]
    assert texts.best_beta(points).first().k == 0
    out = spark.createDataFrame([("p", "Saved: a\nDone: x\nSaved: b\n")], "path string, text string")
    assert {(x.name, x.value) for x in texts.saved_paths(out).collect()} == {("Saved", "b"), ("Done", "x")}


def test_width_blocks_hand_case(spark):
    text = "distance,original,10^-1_a,10^-1_b,10^0_a,10^0_b\n0,1,1,5,5,5\n0,2,3,7,7,7\n"
    got = {(x.k, x.i): (x.xi, x.mean, x.low, x.high) for x in texts.width_blocks(spark.createDataFrame([("p", text)], "path string, text string")).collect()}
    assert got == {(-1, 0): (0, 3, 1, 5), (-1, 1): (1, 5, 3, 7), (0, 0): (0, 5, 5, 5), (0, 1): (1, 7, 7, 7)}


def test_projection_ranges_and_recommendation(spark):
    p = spark.createDataFrame([(126.978, 37.5665)], "x double, y double")
    for key, (x, y) in {"epsg5179": (954_000, 1_952_000), "epsg5181": (198_000, 452_000), "epsg5186": (198_000, 552_000), "epsg5174": (198_000, 452_000)}.items():
        got = crs.transform(p, crs.SYSTEMS["epsg4326"], crs.SYSTEMS[key]).first()
        assert abs(got.x - x) < 1_500 and abs(got.y - y) < 1_500, (key, got)
    boxes = spark.createDataFrame([("a", "roads 2015", 126.9, 37.4, 127.1, 37.6), ("b", "x", 5e7, 5e7, 6e7, 6e7)], "layer string, name string, xmin double, ymin double, xmax double, ymax double")
    got = {x.layer: (x.key, x.confidence) for x in crs.recommend(boxes).collect()}
    assert got == {"a": ("epsg4326", "medium"), "b": (None, None)}
    with_project = crs.recommend(boxes, crs.SYSTEMS["epsg5179"], (940_000, 1_930_000, 970_000, 1_970_000))
    assert {x.layer: x.key for x in with_project.collect()}["a"] == "epsg4326"


def test_unit_is_the_last_one(spark):
    text = 'PROJCS["a",GEOGCS["b",UNIT["Degree",0.0174532925199433]],UNIT["Meter",1.0]]'
    assert spark.createDataFrame([(text,)], "prj string").select(crs.unit_of(F.col("prj")).alias("u")).first().u.kind == "meter"


def test_drawn_arrows_are_read(spark):
    matrix = np.zeros((4, 5), int)
    matrix[0, 1], matrix[2, 3], matrix[3, 0] = 1, 2, 4
    canvas = imaging.draw(matrix, 40)
    images = spark.createDataFrame([("i", *canvas.shape, bytearray(canvas.tobytes()))], "image_id string, height int, width int, channels int, data binary")
    got = {(x.r, x.c): x.d for x in imaging.directions(images, 4, 5).collect()}
    assert got == {(0, 1): 1, (2, 3): 2, (3, 0): 4}


def test_vote_stream_equals_batch(spark, tmp_path):
    rows = [("g", i % 3, i % 2, 1 + i % 4, i) for i in range(60)]
    df = spark.createDataFrame(rows, "grid_id string, r int, c int, d int, w long")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.vote_stream(stream).writeStream.outputMode("complete").format("memory").queryName("votes_out").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(x) for x in spark.table("votes_out").collect()} == {tuple(x) for x in streams.vote_stream(df).collect()}


def test_layers_load_with_their_errors(spark, tmp_path):
    from catchment.sources import labels

    good = {"a.shp": shp(3, [[[(0, 0), (5, 5)]]]), "b.shp": shp(5, [[[(0, 0), (4, 0), (4, 4)]]]), "c.shp": b"no shapefile", "d.shp": shp(1, [])}
    for name, content in good.items():
        (tmp_path / name).write_bytes(content)
    points, errors = labels.load_layers(spark, [str(tmp_path / n) for n in good])
    assert {(x.path.rsplit("/")[-1], x.kind, x.x, x.y) for x in points.collect()} == {("a.shp", 3, 0, 0), ("a.shp", 3, 5, 5), ("b.shp", 5, 0, 0), ("b.shp", 5, 4, 0), ("b.shp", 5, 4, 4)}
    assert {x.path.rsplit("/")[-1]: x.error for x in errors.collect()} == {"c.shp": "not a shapefile", "d.shp": "shape type isn't supported: point"}


def test_audit_file_has_all_columns(spark, tmp_path):
    from catchment.sources import labels

    one, two = spark.createDataFrame([(1, "a")], "n int, image string"), spark.createDataFrame([("b", 0.5)], "image string, share double")
    labels.write_audit([one, two], str(tmp_path / "audit"))
    got = spark.read.option("header", True).csv(str(tmp_path / "audit"))
    assert got.columns == ["n", "image", "share"] and {(x.n, x.image, x.share) for x in got.collect()} == {("1", "a", None), (None, "b", "0.5")}
