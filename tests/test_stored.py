"""Versioned tables, the training set on them, the segment index, shapefiles by the data source, wanted results."""

import datetime
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catchment.operators import spatial, training_store
from catchment.operators.training_store import TrainingStore
from catchment.sources import segment_index, shape_source, shapefile, writers
from catchment.sources.segment_index import SegmentIndex
from catchment.sources.shape_source import ShapeReader
from catchment.sources.snapshots import Conflict, Snapshots
from catchment.streaming import tasks


@pytest.fixture
def place(spark, tmp_path):
    return f"file://{tmp_path}/table"


# versions

def ids(frame):
    return sorted(x.id for x in frame.collect())


def test_versions(spark, place):
    table = Snapshots(spark, place)
    assert table.version() is None
    with pytest.raises(ValueError):
        table.read()
    table.append(spark.range(3), "first")
    table.append(spark.range(3, 5))
    table.replace(spark.range(10, 12), table.version())
    assert [ids(table.read(n)) for n in table.numbers()] == [[0, 1, 2], [0, 1, 2, 3, 4], [10, 11]]
    assert table.version(0).note == "first" and ids(table.read()) == [10, 11]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(ValueError):
        table.read(7)


def test_a_dead_writer_leaves_the_old_version(spark, place, monkeypatch):
    table = Snapshots(spark, place)
    table.append(spark.range(3))
    monkeypatch.setattr(table.folder, "claim", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.replace(spark.range(9), table.version())
    again = Snapshots(spark, place)
    assert ids(again.read()) == [0, 1, 2] and again.numbers() == [0]
    again.append(spark.range(5, 6))
    assert ids(again.read()) == [0, 1, 2, 5]
    assert again.expire(1, older=3600) == 0  # the dead writer's folder is too young to go
    assert again.expire(1, older=0) == 1 and ids(again.read()) == [0, 1, 2, 5] and again.numbers() == [1]


def test_second_writer(spark, place):
    one, two = Snapshots(spark, place), Snapshots(spark, place)
    one.append(spark.range(2))
    seen = two.version()
    one.append(spark.range(2, 3))
    with pytest.raises(Conflict):
        two.replace(spark.range(50), seen)
    assert ids(one.read()) == [0, 1, 2]
    calls = []

    def change(rows):
        calls.append(1)
        if len(calls) == 1:
            one.append(spark.range(3, 4))  # comes between
        return rows.withColumn("id", F.col("id") + 100), "moved"

    two.update(change)
    assert ids(one.read()) == [100, 101, 102, 103] and len(calls) == 2 and one.version().note == "moved"


def test_appends_at_once_all_count(spark, place):
    Snapshots(spark, place).append(spark.range(1))
    errors = []

    def work(k):
        try:
            Snapshots(spark, place).append(spark.range(10 * k, 10 * k + 3))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = Snapshots(spark, place)
    assert not errors and table.numbers() == list(range(6))
    assert ids(table.read()) == [0] + [10 * k + j for k in range(1, 6) for j in range(3)]


def test_expired_versions_go(spark, place):
    table = Snapshots(spark, place)
    for k in range(4):
        table.replace(spark.range(k, k + 1), table.version())
    assert table.expire(2, older=0) == 2 and table.numbers() == [2, 3]
    assert ids(table.read(2)) == [2] and ids(table.read()) == [3]
    with pytest.raises(ValueError):
        table.expire(0)


# training set

def test_training_store(spark, place, monkeypatch):
    monkeypatch.setattr(training_store, "RUNS", 3)
    store = TrainingStore(Snapshots(spark, place), 2)
    rng = random.Random(4)
    batches = [[([float(rng.randrange(3)), float(rng.randrange(2))], rng.randrange(5), k) for k in range(n)] for n in (40, 1, 25)]
    batches[2] += [([1.0, 1.0], k % 2, 100 + k) for k in range(60)]  # one vector fills the batch
    held, last = {}, None
    assert store.samples().count() == 0 and store.append(spark.createDataFrame([], "x array<double>, label int, place long")) is None
    for n, batch in enumerate(batches):
        rows = list(held.values()) + [(tuple(x), y, n, p) for x, y, p in batch]
        before, conflicts = {}, 0
        for x, y, b, p in rows:
            conflicts += x in before and before[x][1] != y
            before[x] = (x, y, b, p)
        store.append(spark.createDataFrame(batch, "x array<double>, label int, place long").repartition(3), "key" if n == 1 else None)
        held = before
        assert store.counts() == {"removed": len(rows) - len(held), "conflicts": conflicts}
        got = {(tuple(r.x), r.label, r.batch, r.place) for r in store.samples().collect()}
        assert got == set(held.values())
        last = {r.batch: r.group_id for r in store.samples().collect()}
    assert set(last) <= {0, 1, 2} and last[2] in (1, training_store.group_number("key") + 1)
    for bad in ([1.0], [1.0, float("nan")], [1.0, None], None):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([(bad, 1, 0)], "x array<double>, label int, place long"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([([1.0, 2.0], 5, 0)], "x array<double>, label int, place long"))
    assert store.reset() and store.samples().count() == 0 and store.samples(2).count() == len(held)


# segment index

SEGMENTS = "grid_id string, feature_id long, part int, seg int, x0 double, y0 double, x1 double, y1 double"


def lines(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = (rng.uniform(0, 1000), rng.uniform(0, 1000)) if i % 2 else (rng.gauss(200, 4), rng.gauss(700, 4))
        out.append(("g", i, 0, 0, x, y, x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)))
    return out + [("g", n + k, 0, 0, 50.0, 50.0, 50.0, 50.0) for k in range(n // 3)]  # a third at one place


def test_window_reads_only_touched_files(spark, place):
    rows = lines(1500) + [("g", 9000, 0, 0, None, 1.0, 2.0, 3.0), ("g", 9001, 0, 0, float("nan"), 1.0, 2.0, 3.0)]
    index = SegmentIndex.build(spark.createDataFrame(rows, SEGMENTS).repartition(4), place, "v1", leaf_rows=60, depth=8, file_rows=100)
    assert index.rows().count() == len(rows)
    sizes = index.entries.groupBy("_leaf", "_part").agg(F.sum("rows").alias("n")).collect()
    assert max(x.n for x in sizes) <= 2 * 60 and len({x["_leaf"] for x in sizes}) > 10
    whole = [r for r in rows if r[4] is not None and r[4] == r[4]]
    for w in ((495.0, 495.0, 520.0, 530.0), (0.0, 0.0, 1000.0, 1000.0), (50.0, 50.0, 50.0, 50.0), (-9e9, -9e9, -8e9, -8e9)):
        want = Counter(r[1] for r in whole if min(r[4], r[6]) <= w[2] and max(r[4], r[6]) >= w[0] and min(r[5], r[7]) <= w[3] and max(r[5], r[7]) >= w[1])
        found = index.window(*w)
        assert Counter(x.feature_id for x in found.collect()) == want
    small = index.window(450.0, 450.0, 560.0, 570.0)
    files = {f.rsplit("/", 1)[-1] for f in small.inputFiles()}
    everything = index.entries.select("file").distinct().count()
    read = index.entries.where(F.col("file").isin(list(files))).agg(F.sum("rows")).first()[0]
    assert len(files) < everything / 3 and read < len(rows) / 3 and small.count() > 0


def test_index_join_and_clip(spark, place):
    rows = lines(600, 5)
    segments = spark.createDataFrame(rows, SEGMENTS)
    squares = [(k, 0, e, *xy) for k, (x, y, s) in enumerate([(190, 690, 20), (0, 0, 500), (49, 49, 2), (2000, 0, 5)]) for e, xy in enumerate([(x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y)])]
    rings = spark.createDataFrame([(a, b, c, *map(float, xy)) for a, b, c, *xy in squares], "feature_id long, ring int, edge int, x0 double, y0 double, x1 double, y1 double")
    index = SegmentIndex.build(segments, place, leaf_rows=40, depth=7, file_rows=80)
    areas = spatial.boxes(rings, "feature_id").withColumnRenamed("feature_id", "area")
    boxes = {r.area: r for r in areas.collect()}
    want = Counter((r[1], a) for r in rows for a, b in boxes.items() if min(r[4], r[6]) <= b.xmax and max(r[4], r[6]) >= b.xmin and min(r[5], r[7]) <= b.ymax and max(r[5], r[7]) >= b.ymin)
    assert Counter((x.feature_id, x.area) for x in index.near(areas, "area").collect()) == want
    key = lambda frame: Counter((x.feature_id, x.boundary_id, x.piece, round(x.x0, 9), round(x.y1, 9), x.ox0) for x in frame.collect())
    assert key(index.clip(rings)) == key(spatial.clip_segments(segments, rings)) != Counter()


def test_index_is_built_once(spark, place, monkeypatch):
    segments = spark.createDataFrame(lines(40), SEGMENTS)
    one = SegmentIndex.build_once(segments, place, "a")
    same = SegmentIndex.build_once(segments.limit(0), place, "a")
    assert same.note["rows"] == one.note["rows"]
    other = SegmentIndex.build_once(spark.createDataFrame(lines(10, 3), SEGMENTS), place, "b")
    assert other.rows().count() == 13 and one.rows().count() == 53  # a reader keeps what it opened
    empty = SegmentIndex.build(segments.limit(0), place, "c")
    assert empty.rows().count() == 0 and empty.window(0, 0, 1, 1).count() == 0
    monkeypatch.setattr(Snapshots, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        SegmentIndex.build(segments, place, "d")
    assert SegmentIndex(spark, place).note["source"] == "c"
    with pytest.raises(ValueError):
        SegmentIndex(spark, place + "-none")
    with pytest.raises(ValueError):
        SegmentIndex.build(segments.withColumn("_leaf", F.lit(1)), place)


# shapefiles

@pytest.fixture
def shapes(spark, tmp_path):
    rng = random.Random(8)
    points = [("a.shp", r, p, s, rng.uniform(0, 100), rng.uniform(0, 100)) for r in range(300) for p in range(1 + r % 3) for s in range(2 + r % 4)]
    points += [("b.shp", 0, 0, s, float(s), 1.0) for s in range(4)]
    frame = spark.createDataFrame(points, "path string, record int, part int, seq int, x double, y double")
    files = writers.shapefiles(frame)
    writers.saved(files, f"file://{tmp_path}/s")
    writers.saved(writers.indexes(files.where("path = 'a.shp'")), f"file://{tmp_path}/s")
    shape_source.register(spark)
    return f"{tmp_path}/s", files


def test_shape_source(spark, shapes):
    path, files = shapes
    rows = spark.read.format("shapefile").option("bytes", 2000).load(path)
    assert rows.rdd.getNumPartitions() > 8
    key = lambda frame: Counter((x.path.rsplit("/", 1)[-1], x.kind, x.record, x.part, x.seq, x.x, x.y) for x in frame.collect())
    assert key(rows) == key(shapefile.read_points(files))
    some = spark.read.format("shapefile").option("columns", "record,x").load(f"{path}/a.shp").where("record = 7")
    assert some.columns == ["record", "x"] and some.count() == 2 * (2 + 7 % 4)
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("shapefile").option("columns", "z").load(path)


def test_shape_filters(spark, shapes):
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan, LessThanOrEqual

    path, files = shapes
    reader = ShapeReader({"path": f"{path}/a.shp", "bytes": "2000"}, ["record", "rxmin", "x"])
    filters = [GreaterThanOrEqual(("record",), 100), LessThan(("record",), 120), LessThanOrEqual(("rxmin",), 20.0)]
    assert list(reader.pushFilters(filters)) == filters
    parts = reader.partitions()
    assert sum(p.last - p.first for p in parts) == 20
    got = {r for p in parts for b in reader.read(p) for r in b.column("record").to_pylist()}
    lows = {x.record: x.low for x in shapefile.read_points(files.where("path = 'a.shp'")).groupBy("record").agg(F.min("x").alias("low")).collect()}
    assert got == {r for r in range(100, 120) if lows[r] <= 20}
    frame = spark.read.format("shapefile").load(f"{path}/a.shp").where("record >= 100 AND record < 120 AND rxmin <= 20")
    assert {x.record for x in frame.collect()} == got
    other = ShapeReader({"path": f"{path}/a.shp"}, ["record"])
    list(other.pushFilters([In(("record",), (5, 250))]))
    assert {r for p in other.partitions() for b in other.read(p) for r in b.column("record").to_pylist()} == {5, 250}


def test_bad_shapefiles(spark, shapes, tmp_path):
    path, files = shapes
    content = files.where("path = 'b.shp'").first().content
    for name, data, error in (("cut.shp", content[:-5], "truncated"), ("no.shp", b"x" * 200, "not a shapefile"), ("kind.shp", content[:32] + b"\x08" + content[33:], "shape type 8")):
        (tmp_path / name).write_bytes(bytes(data))
        with pytest.raises(Exception, match=error):
            spark.read.format("shapefile").load(str(tmp_path / name)).collect()


# wanted results

def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def plain_wanted(rows):
    state, out = {}, []
    for task, ts, kind, generation, value in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] in tasks.ORDER and (r[2] == "cancel" or r[3] is not None)), key=lambda r: (r[1], tasks.ORDER.index(r[2]), r[3] is not None, r[3] or 0)):
        newest, closed = state.get(task, (None, False))
        own = newest if generation is None else generation
        if own is None or newest is not None and own < newest:
            continue
        if newest is None or own > newest:
            closed = False
        if kind == "result" and not closed:
            out.append((task, ts, own, value))
        state[task] = (own, closed or kind != "start")
    return Counter(out)


def task_rows():
    day = 24 * 60
    rows = [
        (1, at(0), "start", 5, None), (1, at(5), "result", 5, "five"), (1, at(day), "result", 2, "stale, a day late"), (1, at(2 * day), "start", 6, None), (1, at(2 * day + 1), "result", 5, "stale"), (1, at(2 * day + 2), "result", 6, "six"), (1, at(2 * day + 3), "result", 6, "again"),
        (2, at(0), "start", 1, None), (2, at(1), "cancel", None, None), (2, at(day), "result", 1, "cancelled"), (2, at(day + 1), "start", 2, None), (2, at(day + 2), "cancel", 1, "late cancel"), (2, at(day + 3), "result", 2, "two"),
        (3, at(1), "result", 4, "no start seen"), (4, at(0), "cancel", None, None), (4, at(1), "cancel", 3, None), (4, at(2), "result", 3, "cancelled before"), (4, at(3), "result", None, "no generation"),
        (None, at(0), "result", 1, "no task"), (5, None, "result", 1, "no time"), (5, at(0), "pause", 1, "no kind"),
    ]
    rng = random.Random(6)
    rows += [(rng.randrange(6, 9), at(rng.randrange(4 * day)), rng.choice(["start", "result", "result", "cancel"]), rng.choice([None, *range(1, 9)]), str(k)) for k in range(400)]
    return rows


def test_wanted_in_a_table(spark):
    rows = task_rows()
    frame = spark.createDataFrame(rows, tasks.EVENTS)
    for slices in ("hour", "day", "year"):
        assert Counter((x.task, x.ts, x.generation, x.value) for x in tasks.wanted(frame, slices).collect()) == plain_wanted(rows)
    assert tasks.wanted(frame.limit(0)).count() == 0


@pytest.mark.parametrize("forget", [None, 30 * 24 * 3_600_000])
def test_wanted_in_a_stream(spark, tmp_path, forget):
    rows = task_rows()
    timed = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
    for k in range(3):  # a day is between a result and its stale sibling
        part = [r for r in timed if k * 1920 <= (r[1] - at(0)).total_seconds() / 60 < (k + 1) * 1920]
        spark.createDataFrame(part, tasks.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        stream = spark.readStream.schema(tasks.EVENTS).parquet(f"{tmp_path}/in")
        run = tasks.wanted_stream(stream, forget_ms=forget).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination()
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(tasks.RESULTS).parquet(f"{tmp_path}/out")
    assert Counter((x.task, x.ts, x.generation, x.value) for x in got.collect()) == plain_wanted(timed)


def test_key_groups_are_cut():
    assert training_store.group_number("a") == training_store.group_number("a") != training_store.group_number("b")
    assert 0 <= training_store.group_number("x") < 1 << 63
    assert segment_index.LEAF_ROWS <= segment_index.FILE_ROWS
