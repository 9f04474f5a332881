"""Verbs on whole workspaces."""

import pytest
from pyspark.sql import functions as F

from catchment.operators import graph, reports

CELLS = "grid_id string, r int, c int, d int"


def test_repair_fills_again_and_drops_what_is_lost(spark):
    pipes = [("g", r, 4, 2) for r in range(1, 8)] + [("g", 3, c, 1) for c in range(1, 4)] + [("g", 6, 6, 1)]
    filled = [("g", 5, c, 1) for c in range(0, 4)]
    cells = spark.createDataFrame(pipes + filled, CELLS)
    basin = spark.createDataFrame([("g", r, c) for r in range(1, 8) for c in range(0, 8)], "grid_id string, r int, c int")
    outlets = spark.createDataFrame([("g", 7, 4, 1)], "grid_id string, r int, c int, label int")
    done = reports.assist(cells, spark.createDataFrame(filled, CELLS), basin, outlets)
    rows = {(x.r, x.c): (x.d, x.origin) for x in done.collect()}
    assert set(rows) >= {(r, c) for r in range(1, 8) for c in range(0, 8)}
    assert rows[3, 2] == (1, "kept") and rows[5, 1][1] == "filled"
    reach = {(x.r, x.c) for x in graph.reaching(done.select("grid_id", "r", "c", "d"), outlets).collect()}
    assert set(rows) <= reach


def test_compress_verb(spark):
    cells = spark.createDataFrame([("g", r, c, 1 if c < 7 else 2) for r in range(8) for c in range(8)], CELLS)
    outlet = spark.createDataFrame([("g", 7, 7)], "grid_id string, r int, c int")
    whole = cells.select("grid_id", "r", "c")
    done, small = reports.compress_workspace(cells, outlet, (8, 8), (4, 4), {"basin": whole}, whole.where("r = 0"), "basin")
    assert done.count() == 16 and small["basin"].count() == 16 and small["flood"].count() == 4
    with pytest.raises(ValueError, match="outside"):
        reports.compress_workspace(cells, outlet, (8, 8), (4, 4), {"basin": whole.where("c < 4")}, None, "basin")
    with pytest.raises(ValueError, match="more than one"):
        reports.compress_workspace(cells, outlet.unionByName(whole.limit(1)), (8, 8), (4, 4), {})


def test_training_sets_are_checked(spark):
    schema = "sample_id long, x array<double>, label int, group_id long, version int, patch array<double>"
    good = (1, [1.0, 2.0], 3, None, 5, None)
    row = reports.checked_samples(spark.createDataFrame([good], schema), 2).first()
    assert row.group_id == -2 and len(row.patch) == 768
    for bad in ((1, [1.0], 3, 1, 5, None), (1, [1.0, float("nan")], 3, 1, 5, None), (1, [1.0, 2.0], 5, 1, 5, None), (1, [1.0, 2.0], 1, 1, 4, None), (1, [1.0, 2.0], 1, 1, 5, [0.5])):
        with pytest.raises(Exception, match="can't be used|values"):
            reports.checked_samples(spark.createDataFrame([bad], schema), 2).collect()


def test_synthetic_batches(spark):
    labels = spark.createDataFrame([("g", 0, 0, 1), ("g", 0, 1, 0)], CELLS)

    def features(keys):
        cells = keys.withColumn("r", F.lit(0)).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
        return cells.select("grid_id", "variant", "r", "c", F.array(F.col("variant") + F.col("c")).alias("x"), F.array(F.lit(0.5)).alias("patch"))

    got = reports.synthetic_batch(labels, 3, features).collect()
    assert len(got) == 6 and {x.group_id for x in got} == {"g#0", "g#1", "g#2"} and {(x.c, x.label) for x in got} == {(0, 1), (1, 0)}
