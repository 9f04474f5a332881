"""Streams of labels, results and engine lines, fed by files."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from catchment.operators import evaluate
from catchment.streaming import votes as streams

LABELS = "grid_id string, r int, c int, d int, reviewed boolean"


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, rows, schema, path):
    """Rows as a file of their own in the stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_labels_merge_batch_by_batch(spark, tmp_path):
    one = [("a", r, c, 1, r % 2 == 0) for r in range(6) for c in range(6)]
    two = [("a", r, 3, 2, r % 3 == 0) for r in range(9)] + [("b", 0, 0, 4, True)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (one, two):
        put(spark, batch, LABELS, folder)
        streams.upsert_labels(feed(spark, folder, LABELS), out, ["grid_id", "r", "c"]).trigger(availableNow=True).start().awaitTermination()
    frames = [spark.createDataFrame(x, LABELS) for x in (one, two)]
    want = evaluate.upsert(frames[0], frames[1], ["grid_id", "r", "c"])
    got = streams.current_labels(spark, out)
    assert Counter(map(tuple, got.select("grid_id", "r", "c", "d", "reviewed").collect())) == Counter(map(tuple, want.collect()))
    rows = spark.read.parquet(out + "/labels")
    touched = {x.bucket for x in rows.where("version = 1").select("bucket").distinct().collect()}
    assert touched == {x.b for x in frames[1].select(streams.bucket_of(["grid_id", "r", "c"]).alias("b")).distinct().collect()}


def run(frame, mode):
    name = f"out_{abs(hash(str(frame.schema)))}"
    frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.table(name)


def at(minute, day=1):
    return datetime.datetime(2026, 1, day, 10, minute)


def test_newest_generation_wins(spark, tmp_path):
    schema = "task string, generation int, ts timestamp, value int"
    folder = str(tmp_path / "in")
    put(spark, [("t", 2, at(1), 20), ("u", 1, at(1), 1)], schema, folder)
    put(spark, [("t", 1, at(5), 10)], schema, folder)
    got = run(streams.newest(feed(spark, folder, schema)), "complete")
    assert {(x.task, x.generation, x.result.value) for x in got.collect()} == {("t", 2, 20), ("u", 1, 1)}


def test_windows_and_progress(spark, tmp_path):
    schema = "grid_id string, r int, c int, d int, w long, ts timestamp"
    folder = str(tmp_path / "votes")
    put(spark, [("g", 1, 1, 2, 5, at(1)), ("g", 1, 1, 2, 7, at(3)), ("g", 1, 1, 2, 1, at(15))], schema, folder)
    got = run(streams.windowed_votes(feed(spark, folder, schema)), "complete")
    assert sorted(x.w for x in got.collect()) == [1, 12]
    schema = "task string, line string, ts timestamp"
    folder = str(tmp_path / "lines")
    put(spark, [("e", "k=-2 beta 1e-3", at(1)), ("e", "  ", at(2)), ("e", "run 7", at(4))], schema, folder)
    got = run(streams.progress_counts(feed(spark, folder, schema)), "complete").collect()
    assert [(x.task, x.lines, x["last"]) for x in got] == [("e", 2, "run=7")]


def test_stream_and_batch_sums_agree(spark, tmp_path):
    schema = "grid_id string, r int, c int, d int, w long"
    rows = [("g", i % 3, i % 2, 1 + i % 4, i) for i in range(50)]
    folder = str(tmp_path / "in")
    put(spark, rows[:20], schema, folder)
    put(spark, rows[20:], schema, folder)
    got = run(streams.vote_stream(feed(spark, folder, schema)), "complete")
    want = spark.createDataFrame(rows, schema).groupBy("grid_id", "r", "c", "d").agg(F.sum("w").alias("w"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
