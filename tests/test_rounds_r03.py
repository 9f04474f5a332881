"""Plans and results of grid queries whose cost grew faster than their input."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from catchment.operators import context, correction, graph, masks, reports, workspace
from catchment.streaming import tasks


def plan_of(df):
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_cells(df):
    """The broadcast joins by cell; those by grid, row or column hold few rows."""
    keys = [line.split("BroadcastHashJoin [")[1].split("]")[0] for line in plan_of(df).splitlines() if "BroadcastHashJoin [" in line]
    return [k for k in keys if "r#" in k and "c#" in k]


def random_cells(spark, grids=3, rows=8, cols=9, seed=1, share=0.7):
    """A table of cells whose files are tiny, and the same cells as a list."""
    rng = random.Random(seed)
    own = [(f"g{g}", r, c, rng.randrange(1, 5)) for g in range(grids) for r in range(rows) for c in range(cols) if rng.random() < share]
    return spark.createDataFrame(own, "grid_id string, r int, c int, d int"), own


def outlets_of(spark, grids=3):
    return spark.createDataFrame([(f"g{g}", 4, c) for g in range(grids) for c in (2, 6)], "grid_id string, r int, c int")


def test_assist_runs_each_repair_once(spark):
    cells, _ = random_cells(spark)
    outlets = outlets_of(spark).withColumn("label", F.col("c"))
    basin = cells.select("grid_id").distinct().select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r")).select("grid_id", "r", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("c"))
    out = reports.assist(cells, cells.where("c = 5"), basin, outlets)
    assert "FlatMapGroupsInPandas" not in plan_of(out)
    assert out.count() == out.select("grid_id", "r", "c").distinct().count() > 0
    assert "REPARTITION_BY_NUM" in plan_of(correction.correct(cells, outlets.where("c = 2")))


def test_written_cells_and_masks_are_not_broadcast(spark):
    cells, own = random_cells(spark)
    held = graph.cut(cells)
    assert "BroadcastHashJoin" not in plan_of(held.join(held.where("d = 1").select("grid_id", "r", "c"), ["grid_id", "r", "c"]))
    few = cells.where("c > 3")
    for done, keep in ((masks.within(cells, few), lambda c: c > 3), (masks.outside(cells, few), lambda c: c <= 3)):
        assert "BroadcastHashJoin" not in plan_of(done)
        assert sorted(tuple(x) for x in done.collect()) == sorted(x for x in own if keep(x[2]))


def follow(own, start, most):
    """The cells of a flow, `most` steps at the most."""
    codes, at, path = {x[:3]: x[3] for x in own}, start, [start]
    for _ in range(most):
        dr, dc = {1: (0, 1), 2: (1, 0), 3: (0, -1), 4: (-1, 0)}[codes[at]]
        at = (at[0], at[1] + dr, at[2] + dc)
        if at not in codes:
            break
        path.append(at)
    return path


def test_run_lengths_take_no_joins(spark, monkeypatch):
    cells, own = random_cells(spark)
    want = {x[:3]: len(follow(own, x[:3], 6)) - 1 for x in own}
    out = graph.run_lengths(cells)
    assert "Join" not in plan_of(out)
    assert {(x.grid_id, x.r, x.c): x.run for x in out.collect()} == want and out.count() == len(own)
    monkeypatch.setattr(graph, "SMALL", 0)
    large = graph.run_lengths(cells)
    assert large.schema == out.schema and "BroadcastHashJoin" not in plan_of(large)
    assert {(x.grid_id, x.r, x.c): x.run for x in large.collect()} == want


def test_shortest_paths_take_no_rounds(spark, monkeypatch):
    cells, own = random_cells(spark, grids=12, share=0.8)
    mask, have = cells.select("grid_id", "r", "c"), {x[:3] for x in own}
    ends = [(f"g{g}", 0, 0, 7, 8 - g % 2) for g in range(12)]
    frame = spark.createDataFrame(ends, "grid_id string, r0 int, c0 int, r1 int, c1 int")
    want = {}
    for g, *se in ends:
        start, goal, seen = (se[0], se[1]), (se[2], se[3]), {(se[0], se[1]): 0}
        for at in (queue := [start]):
            for to in ((at[0] - 1, at[1]), (at[0] + 1, at[1]), (at[0], at[1] - 1), (at[0], at[1] + 1)):
                if (g, *to) in have and to not in seen:
                    seen[to] = seen[at] + 1
                    queue.append(to)
        want[g] = seen.get(goal, 0) + 1
    out = graph.shortest_path(mask, frame)
    assert "Join" not in plan_of(out)
    rows = {(x.grid_id, x.k): (x.r, x.c) for x in out.collect()}
    for g, *se in ends:
        path = [rows[g, k] for k in range(want[g])]
        assert path[0] == (se[0], se[1]) and (want[g] == 1 or path[-1] == (se[2], se[3]))
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 and (g, *b) in have for a, b in zip(path, path[1:]))
    assert len(rows) == sum(want.values()) > 12 and any(n == 1 for n in want.values())
    monkeypatch.setattr(graph, "SMALL", 0)
    large = graph.shortest_path(mask, frame)
    assert large.schema == out.schema and {(x.grid_id, x.k): (x.r, x.c) for x in large.collect()} == rows


def test_guided_cells_hash_numbers(spark):
    cells, own = random_cells(spark, share=0.5)
    support = spark.createDataFrame([(f"g{g}", r, c) for g in range(3) for r in range(8) for c in range(9)], "grid_id string, r int, c int")
    out = graph.guide_to_outlet(cells, support, outlets_of(spark))
    assert "SortAggregate" not in plan_of(out) and "BroadcastHashJoin" not in plan_of(out)
    used, dist = {x[:3] for x in own}, lambda r, c: min(abs(r - 4) + abs(c - k) for k in (2, 6))
    want = {}
    for g, r, c in ((f"g{g}", r, c) for g in range(3) for r in range(8) for c in range(9)):
        near = [(dist(a, b), dist(a, b) > 0 and (g, a, b) not in used, k, code) for k, (a, b, code) in enumerate(((r - 1, c, 4), (r + 1, c, 2), (r, c - 1, 3), (r, c + 1, 1))) if 0 <= a < 8 and 0 <= b < 9 and dist(a, b) < dist(r, c)]
        if (g, r, c) not in used and near:
            want[g, r, c] = (min(near)[3], dist(r, c))
    assert {(x.grid_id, x.r, x.c): (x.d, x.dist) for x in out.collect()} == want and out.count() == len(want)


def test_context_maps_broadcast_no_cells(spark):
    cells, _ = random_cells(spark)
    flagged = cells.withColumns({"occ": (F.col("c") % 4 > 0).cast("int"), "head": F.lit(0)})
    grids = cells.select("grid_id").distinct().withColumns({"rows": F.lit(8), "cols": F.lit(9)})
    out = context.context_maps(flagged, grids)
    assert not broadcast_cells(out)
    assert out.count() == cells.count()


def test_export_reads_cells_once(spark):
    cells, own = random_cells(spark)
    lasso = cells.where("c < 7").select("grid_id", "r", "c")
    kept, counts = workspace.sanitise(cells, outlets_of(spark), lasso)
    for out in (kept, counts):
        assert not broadcast_cells(out)
    assert {x.grid_id: x.outside for x in counts.collect()} == {f"g{g}": sum(x[0] == f"g{g}" and x[2] >= 7 for x in own) for g in range(3)}


def test_vectors_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(context, "TILE", 3)  # most neighbours lie in other tiles
    rng = random.Random(6)
    cells, own = random_cells(spark, grids=2)
    values = {x[:3]: [float(x[3] == k) for k in (1, 2, 3, 4)] + [rng.random() if rng.random() < 0.95 else None for _ in context.LOCAL] for x in own}
    far = {x[:3]: [rng.random() for _ in context.GLOBAL] for x in own}
    names = [*context.LOCAL, *context.GLOBAL]
    frame = spark.createDataFrame([(*x, *values[x[:3]][4:], *far[x[:3]]) for x in own], "grid_id string, r int, c int, d int, " + ", ".join(f"{n} double" for n in names))
    grids = cells.select("grid_id").distinct().withColumns({"rows": F.lit(8), "cols": F.lit(9)})
    out = context.feature_vectors(frame, grids)
    assert "collect_list" not in plan_of(out)
    got = {(x.grid_id, x.r, x.c): x.x for x in out.collect()}
    assert len(got) == out.count() == len(own)
    for (g, r, c), x in got.items():
        around = [v for a in range(-2, 3) for b in range(-2, 3) for v in values.get((g, r + a, c + b), [0.0] * 10)]
        assert x == [*around, r / 7, c / 8, *far[g, r, c]]


def test_fates_are_one_pass(spark, monkeypatch):
    cells, _ = random_cells(spark, grids=6)
    outlets = spark.createDataFrame([(f"g{g}", 4, 4) for g in range(6)], "grid_id string, r int, c int")
    out = graph.fates(cells, outlets)
    assert plan_of(out).count("FlatMapGroupsInArrow") == 1
    good, passing = {tuple(x) for x in graph.reaching(cells, outlets).collect()}, {(x.grid_id, x.r, x.c): x.passing for x in graph.through_counts(cells, outlets).collect()}
    rows = sorted(tuple(x) for x in out.collect())
    assert {x[:3]: x[5] for x in rows} == passing and len(rows) == len(passing)
    assert {x[:3] for x in rows if x[6]} == good & set(passing) and good
    coarse = graph.coarsen(cells, (8, 9), (4, 3), outlets)
    assert all("FlatMapGroupsInArrow" not in plan_of(x) for x in coarse)
    monkeypatch.setattr(graph, "SMALL", 0)
    large = graph.fates(cells, outlets)
    assert large.schema == out.schema and sorted(tuple(x) for x in large.collect()) == rows


def test_inspection_is_one_pass(spark, monkeypatch):
    cells, _ = random_cells(spark, grids=5)
    grids = cells.select("grid_id").distinct().withColumns({"rows": F.lit(8), "cols": F.lit(9)})
    out = graph.inspect(cells, grids, outlets_of(spark, 5))
    assert plan_of(out).count("FlatMapGroupsInArrow") == 1 and plan_of(out).count("Join") == 1  # with the number of outlets
    rows = sorted(tuple(x) for x in out.collect())
    monkeypatch.setattr(graph, "SMALL", 0)
    large = graph.inspect(cells, grids, outlets_of(spark, 5))
    assert large.columns == out.columns and sorted(tuple(x) for x in large.collect()) == rows and len(rows) == 5


class Calls:
    """A state that tells which calls were made."""

    def __init__(self, held):
        self.held, self.made = held, []

    def get(self):
        self.made.append("get")
        return self.held

    def update(self, value):
        self.made.append("update")
        self.held = value


def test_wanted_calls_the_state_no_more_than_it_must():
    row = lambda n, kind, generation: Row(task=7, ts=n, kind=kind, generation=generation, value=str(n))
    one = tasks.Wanted()
    one.state = Calls(None)
    assert [x.value for x in one.handleInputRows((7,), iter([row(1, "start", 3), row(2, "result", 3)]), None)] == ["2"]
    assert one.state.made == ["get", "update"] and one.state.held == (3, True)
    one.state = Calls((3, True))  # a stale result changes nothing
    assert list(one.handleInputRows((7,), iter([row(3, "result", 2)]), None)) == [] and one.state.made == ["get"]
