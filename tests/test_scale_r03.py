"""Plans and results that a review of larger tables asked for."""

import random
import struct
import time

from pyspark.sql import functions as F

from catchment.operators import evaluate, imaging, masks, raster, sections, spatial, workspace
from catchment.sources import shape_source, shapefile, writers


def plan_of(df):
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_supported_paths_broadcast_no_cells(spark):
    rng = random.Random(3)
    raw = [(p, rng.randrange(12), rng.randrange(12)) for p in range(6) for _ in range(25)]
    own = [(p, rng.randrange(12), rng.randrange(12)) for p in range(8) for _ in range(3)]
    kinds = "path_id long, r int, c int"
    out = raster.supported_paths(spark.createDataFrame(own, kinds), spark.createDataFrame(raw, kinds), 2)
    near = lambda p, r, c: any(q == p and abs(a - r) + abs(b - c) <= 2 for q, a, b in raw)
    assert {x.path_id: x.supported for x in out.collect()} == {p: all(near(*o) for o in own if o[0] == p) for p in range(8)}
    # cells from a small table, which look small before they are generated
    spark.range(40).write.mode("overwrite").saveAsTable("few_paths")
    grown = spark.table("few_paths").select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("r"), F.lit(0).alias("c"))
    assert "Broadcast" not in plan_of(raster.supported_paths(grown, grown, 2))


def test_upright_axes_have_one_sign(spark):
    rows = []
    for image in range(40):
        rng = random.Random(image)
        own = [(str(image), 3 * image + k, y, 217, 333, True) for k in (0, 1, 3, 4) for y in range(10)]
        rng.shuffle(own)
        rows += own
    out = imaging.axis_field(spark.createDataFrame(rows, "image_id string, x int, y int, height int, width int, line boolean"), 1, 1).collect()
    assert len(out) == 40 and all(round(x.axis_x, 9) == 0 and round(x.axis_y, 9) == 1 for x in out)


def test_report_rounds_by_binary_value(spark):
    shares = ("precision", "recall", "f1", "accuracy", "strict_recall", "macro_f1")
    rows = [(str(i), *[(100 * i + 50 * (1 + j)) / 1e6 for j in range(6)]) for i in range(300)]
    out = evaluate.report(spark.createDataFrame(rows, ["grid_id", *shares]))
    want = {r[0]: "pipe P=%.4f R=%.4f F1=%.4f | direction acc=%.4f strict=%.4f macro=%.4f" % r[1:] for r in rows}
    assert {x.grid_id: x.line for x in out.collect()} == want


def heads_of(spark, n):
    spark.range(n).write.mode("overwrite").saveAsTable("few_heads")
    k = F.col("id")
    own = spark.table("few_heads").select(F.lit("a").alias("image_id"), k.alias("head_id"), (k * 7 % 90).cast("double").alias("x"), (k * 3 % 70).cast("double").alias("y"), F.lit(1.0).alias("dx"), (k % 3).cast("double").alias("dy"), F.lit(8.0).alias("span"))
    return own, own.select("image_id", F.floor("x").alias("x"), F.floor("y").alias("y"))


def test_heads_are_not_broadcast(spark):
    heads, pixels = heads_of(spark, 60)
    for out in (sections.cross_sections(heads, pixels, (0.18, 0.62)), sections.local_scores(heads, pixels)):
        joins = [line for line in plan_of(out).splitlines() if "BroadcastHashJoin" in line]
        assert all("LeftSemi" in line for line in joins)  # pixels may be


def plain_shapefile(points, kind):
    """A shapefile record by record."""
    shapes = {}
    for record, part, _, x, y in sorted(points):
        shapes.setdefault(record, {}).setdefault(part, []).append((x, y))
    box = lambda ps: (min(x for x, _ in ps), min(y for _, y in ps), max(x for x, _ in ps), max(y for _, y in ps))
    out = []
    for number, parts in enumerate(shapes.values(), 1):
        whole = [p for part in parts.values() for p in part]
        firsts = [sum(len(p) for p in list(parts.values())[:k]) for k in range(len(parts))]
        body = struct.pack("<i4d2i", kind, *box(whole), len(parts), len(whole)) + struct.pack(f"<{len(firsts)}i", *firsts) + b"".join(struct.pack("<2d", *p) for p in whole)
        out.append(struct.pack(">2i", number, len(body) // 2) + body)
    body = b"".join(out)
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i4d", 1000, kind, *box([p[3:] for p in points])) + b"\0" * 32 + body


def test_shapefiles_are_written_in_linear_time(spark):
    rng = random.Random(5)
    points = [(r, p, s, rng.uniform(-9, 9), rng.uniform(-9, 9)) for r in range(50) for p in range(1 + r % 3) for s in range(1 + rng.randrange(4))]
    rng.shuffle(points)
    assert writers.shape_bytes(points, 3) == plain_shapefile(points, 3)
    n = 400_000
    start = time.perf_counter()
    content = writers.shape_bytes([(k, 0, 0, 1.0, 2.0) for k in range(n)], 3)
    assert len(content) == 100 + n * 72 and time.perf_counter() - start < 20  # minutes where the body is copied for each record


def test_points_of_files_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(shapefile, "VERTICES", 7)
    points = [(r, p, s, float(r), float(s)) for r in range(9) for p in range(2) for s in range(3)]
    null = struct.pack(">2i", 10, 2) + struct.pack("<i", 0)
    files = spark.createDataFrame([("a.shp", bytearray(writers.shape_bytes(points, 3) + null))], "path string, content binary")
    out = shapefile.read_points(files)
    got = {(x.record, x.part, x.seq, x.x, x.y) for x in out.collect()}
    assert got == {*points, (9, None, None, None, None)} and out.count() == len(points) + 1


def test_scans_of_shapefiles_have_a_bounded_number_of_ranges(tmp_path):
    content = writers.shape_bytes([(k, 0, 0, 1.0, 2.0) for k in range(5_000)], 3)
    (tmp_path / "a.shp").write_bytes(content)
    (tmp_path / "a.shx").write_bytes(writers.index_bytes(content))
    reader = shape_source.ShapeReader({"path": str(tmp_path), "bytes": "72"}, ["record"])
    parts = reader.partitions()
    assert len(parts) <= 2 * shape_source.STRETCHES and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]] and (parts[0].first, parts[-1].last) == (0, 5_000)


def test_nearest_nodes_of_dense_places(spark):
    rng = random.Random(8)
    spot = lambda: (rng.choice([rng.uniform(-20, 20), float(rng.randrange(-20, 20))]), rng.uniform(-20, 20))
    nodes = [(k, *spot()) for k in range(300)] + [(300 + k, 70.0, 3.0 * k) for k in range(9)]
    nodes += [(1000 + k, *nodes[k][1:]) for k in range(50)]
    targets = [(k, *spot()) for k in range(150)] + [(500 + k, 60.0 + k, 2.5 * k) for k in range(20)] + [(900, *nodes[7][1:])]
    out = spatial.nearest_nodes(spark.createDataFrame(targets, "target_id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"), 5.0, 9.0)
    want = {}
    for t, x, y in targets:
        near = min(((a - x) ** 2 + (b - y) ** 2, n) for n, a, b in nodes)
        if near[0] <= 81:
            want[t] = near[1]
    assert {x.target_id: x.node_id for x in out.collect()} == want and out.count() == len(want)
    # many targets and nodes at the same few places: pairs are those of places
    many = spark.range(20_000).select(F.col("id").alias("target_id"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    dense = many.withColumnRenamed("target_id", "node_id")
    start = time.perf_counter()
    assert spatial.nearest_nodes(many, dense, 5.0, 9.0).where("node_id = target_id % 3").count() == 20_000
    assert time.perf_counter() - start < 60  # 400 million pairs otherwise
    empty = spatial.nearest_nodes(many, dense.where("false"), 5.0, 9.0)
    assert empty.count() == 0 and empty.columns == ["target_id", "node_id"]


def test_boxes_and_clipped_rows_are_not_broadcast(spark):
    spark.range(50).write.mode("overwrite").saveAsTable("few_boxes")
    k = F.col("id").cast("double")
    boxes = spark.table("few_boxes").select("id", k.alias("xmin"), (k % 7).alias("ymin"), (k + 9).alias("xmax"), (k % 7 + 9).alias("ymax"))
    joined = spatial.box_join(boxes, boxes.withColumnRenamed("id", "other"), "id", "other")
    assert "BroadcastHashJoin" not in plan_of(joined)
    assert joined.count() == sum(abs(a - b) <= 9 for a in range(50) for b in range(50))
    segments = spark.table("few_boxes").select(F.lit("g").alias("grid_id"), F.col("id").alias("feature_id"), F.lit(0).alias("part"), F.lit(0).alias("seg"), k.alias("x0"), F.lit(0.0).alias("y0"), k.alias("x1"), F.lit(9.0).alias("y1"))
    ring = [(10.0, 2.0), (30.0, 2.0), (30.0, 5.0), (10.0, 5.0)]
    rings = spark.createDataFrame([(1, 0, e, *ring[e], *ring[(e + 1) % 4]) for e in range(4)], "feature_id int, ring int, edge int, x0 double, y0 double, x1 double, y1 double")
    pieces = spatial.clip_segments(segments, rings)
    plan = plan_of(pieces)
    assert "REPARTITION_BY_COL" in plan and "BuildLeft" not in plan
    assert {(x.feature_id, x.y0, x.y1) for x in pieces.collect()} == {(f, 2.0, 5.0) for f in range(10, 31)}


def test_best_codes_and_heads_hash_cells(spark):
    rng = random.Random(4)
    votes = [("g", r, 0, d, rng.randrange(4)) for r in range(60) for d in (1, 2, 3, 4)]
    got = raster.argmax(spark.createDataFrame(votes, "grid_id string, r int, c int, d int, w long"))
    assert "SortAggregate" not in plan_of(got)
    best = {}
    for _, r, _, d, w in votes:
        if w > 0 and (r not in best or w > best[r][0]):
            best[r] = (w, d)
    assert {x.r: x.d for x in got.collect()} == {r: d for r, (_, d) in best.items()}
    heads = spark.createDataFrame([("g", k, rng.uniform(0, 99), rng.uniform(0, 99), 1.0, 0.0, 0.5) for k in range(40)], "grid_id string, head_id long, x double, y double, dx double, dy double, score double")
    cells = spark.createDataFrame([("g", r, c, 1, 1.0, 0.0, 0.5) for r in range(5) for c in range(5)], "grid_id string, r int, c int, path int, axis_x double, axis_y double, axis_conf double")
    grids = spark.createDataFrame([("g", 5, 5, 100, 100)], "grid_id string, rows int, cols int, width int, height int")
    out = raster.guided_votes(cells, heads.union(heads), grids)  # equal fits: one vote a cell
    assert "SortAggregate" not in plan_of(out) and out.count() == out.select("grid_id", "r", "c").distinct().count() > 0


def test_cells_of_polygons_spread(spark):
    corners = spark.createDataFrame([("g", k, x, y) for k, (x, y) in enumerate([(1.0, 1.0), (9.0, 1.0), (9.0, 9.0)])], "grid_id string, k int, x double, y double")
    grids = spark.createDataFrame([("g", 40, 40, 40.0, 40.0)], "grid_id string, rows int, cols int, width double, height double")
    assert "REPARTITION_BY_NUM" in plan_of(workspace.polygon_cells(corners, grids))


def test_masks_are_not_broadcast(spark):
    one = spark.createDataFrame([("g", k, 0) for k in range(9)], "grid_id string, r int, c int")
    both = masks.intersect(one, one.where("r > 3"))
    assert "Broadcast" not in plan_of(both) and {x.r for x in both.collect()} == {4, 5, 6, 7, 8}
