"""Graph operators against hand cases and naive walks."""

import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.operators import correction, graph, kernels

STEP = {1: (0, 1), 2: (1, 0), 3: (0, -1), 4: (-1, 0)}


def frame(spark, grids):
    rows = [(str(g), r, c, d) for g, m in enumerate(grids) for r, line in enumerate(m) for c, d in enumerate(line) if d]
    return spark.createDataFrame(rows, "grid_id string, r int, c int, d int")


def dims(spark, grids):
    return spark.createDataFrame([(str(g), len(m), len(m[0])) for g, m in enumerate(grids)], "grid_id string, rows int, cols int")


@pytest.fixture(scope="module")
def random_grids():
    rng = random.Random(5)
    shapes = [(rng.randint(2, 7), rng.randint(2, 7)) for _ in range(60)]
    return [[[rng.choice([0, 1, 2, 3, 4]) for _ in range(w)] for _ in range(h)] for w, h in shapes]


def follow(m, r, c):
    """(sink, steps), or None for a cycle."""
    seen = set()
    while True:
        if (r, c) in seen:
            return None
        seen.add((r, c))
        dr, dc = STEP[m[r][c]]
        nr, nc = r + dr, c + dc
        if not (0 <= nr < len(m) and 0 <= nc < len(m[0])) or not m[nr][nc]:
            return (r, c), len(seen) - 1
        r, c = nr, nc


@pytest.fixture(params=["groups", "tables"])
def ways(request, monkeypatch):
    """Both ways of the graph operators: a group a grid, and joins."""
    if request.param == "tables":
        monkeypatch.setattr(graph, "SMALL", 0)


def test_both_ways_agree(spark, random_grids, monkeypatch):
    """Grids on both sides of the limit in one call."""
    cells = frame(spark, random_grids[:20])
    calls = {"passing": lambda: graph.through_counts(cells), "cycles": lambda: graph.cycle_cells(cells), "components": lambda: graph.components(cells), "spread": lambda: graph.spread(cells.where("r < 2").withColumn("label", F.col("c")), cells)}
    one = {k: Counter(map(tuple, f().collect())) for k, f in calls.items()}
    monkeypatch.setattr(graph, "SMALL", 8)
    assert {k: Counter(map(tuple, f().collect())) for k, f in calls.items()} == one and all(one.values())


def test_far_cells_spread_alike():
    rng = random.Random(3)
    cells = np.array([(rng.randrange(9), rng.randrange(9)) for _ in range(60)])
    seeds = np.unique(np.array([(rng.randrange(9), rng.randrange(9), 0) for _ in range(5)]), axis=0)
    near, far = kernels.breadth_first(seeds, cells), kernels.sparse_first(seeds, cells)
    assert all(np.array_equal(a, b) for a, b in zip(near, far))


def test_trace_matches_walks(spark, random_grids, ways):
    t = graph.trace(frame(spark, random_grids))
    got = {(int(x.grid_id), x.r, x.c): None if x.sr is None else ((x.sr, x.sc), x.depth) for x in t.select("grid_id", graph.row_of("id").alias("r"), graph.col_of("id").alias("c"), graph.row_of("sink").alias("sr"), graph.col_of("sink").alias("sc"), "depth").collect()}
    want = {(g, r, c): follow(m, r, c) for g, m in enumerate(random_grids) for r, line in enumerate(m) for c, d in enumerate(line) if d}
    assert got == want


def test_reaching_matches_reverse_search(spark, random_grids, ways):
    rng = random.Random(2)
    stops = [(str(g), rng.randrange(len(m)), rng.randrange(len(m[0]))) for g, m in enumerate(random_grids)]
    found = graph.reaching(frame(spark, random_grids), spark.createDataFrame(stops, "grid_id string, r int, c int"))
    want = set()
    for g, r, c in stops:
        m, queue, seen = random_grids[int(g)], deque([(r, c)]), {(r, c)}
        while queue:
            r, c = queue.popleft()
            for code, (dr, dc) in STEP.items():
                at = (r - dr, c - dc)
                if 0 <= at[0] < len(m) and 0 <= at[1] < len(m[0]) and at not in seen and m[at[0]][at[1]] == code:
                    seen.add(at)
                    queue.append(at)
        want |= {(g, *x) for x in seen}
    assert {tuple(x) for x in found.collect()} == want


def test_gamma_hand_case(spark, ways):
    """A comb: a spine of six cells eastwards, with teeth of three cells from above and one from below."""
    comb = [[0, 0, 2, 0, 0, 0], [0, 0, 2, 0, 0, 0], [0, 0, 2, 0, 0, 0], [1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 4, 0]]
    chains = graph.flowlines(frame(spark, [comb]))
    # the tooth comes three steps from the confluence, the spine's first cell only two: the tooth goes on
    assert sorted(x.length for x in chains.collect()) == [1, 2, 7]
    g = graph.gamma_index(chains).first()
    assert (g.cells, g.chains, g.longest) == (10, 3, 7)
    assert g.centre == pytest.approx((49 + 4 + 1) / 10) and g.gamma == pytest.approx(5.4 / 7)


def peel(m):
    """Lengths and starts of the lines left by always removing the longest, naively."""
    sinks = {}
    for r, line in enumerate(m):
        for c, d in enumerate(line):
            if d and (f := follow(m, r, c)):
                sinks.setdefault(f[0], []).append((r, c))
    if not sinks:
        return None
    main = max(sinks, key=lambda s: (len(sinks[s]), -s[1], -s[0]))
    live, out = set(sinks[main]), []
    while live:
        best = None
        for r, c in live:
            at, path = (r, c), []
            while at in live:
                path.append(at)
                dr, dc = STEP[m[at[0]][at[1]]]
                at = (at[0] + dr, at[1] + dc)
            key = (len(path), -c, -r)
            if best is None or key > best[0]:
                best = (key, path)
        live -= set(best[1])
        out.append((len(best[1]), best[1][0]))
    return sorted(out)


def test_flowlines_match_peeling(spark, random_grids, ways):
    got = {}
    for x in graph.flowlines(frame(spark, random_grids)).select("grid_id", "length", graph.row_of("start").alias("r"), graph.col_of("start").alias("c")).collect():
        got.setdefault(int(x.grid_id), []).append((x.length, (x.r, x.c)))
    for g, m in enumerate(random_grids):
        assert sorted(got.get(g, [])) == (peel(m) or [])


def naive_fill(m, basin):
    out = [list(line) for line in m]
    queue = deque((r, c) for r, line in enumerate(m) for c, d in enumerate(line) if d)
    while queue:
        r, c = queue.popleft()
        for dr, dc, back in ((-1, 0, 2), (1, 0, 4), (0, -1, 1), (0, 1, 3)):
            y, x = r + dr, c + dc
            if 0 <= y < len(m) and 0 <= x < len(m[0]) and (y, x) in basin and not out[y][x]:
                out[y][x] = back
                queue.append((y, x))
    return {(r, c, d) for r, line in enumerate(out) for c, d in enumerate(line) if d}


def test_fill_follows_queue_order(spark, ways):
    rng = random.Random(8)
    # a cell between two seeds goes to the one that the queue takes first; a seed's own neighbours come in the order north, south, west, east
    grids = [[[0, 0, 0], [1, 0, 2], [0, 0, 0]], [[2], [0], [0], [0], [2]]] + [[[rng.choice([0, 0, 0, 0, 1, 2]) for _ in range(9)] for _ in range(7)] for _ in range(8)]
    basins = [{(r, c) for r in range(len(m)) for c in range(len(m[0])) if g < 2 or rng.random() < 0.85} for g, m in enumerate(grids)]
    basin = spark.createDataFrame([(str(g), r, c) for g, b in enumerate(basins) for r, c in b], "grid_id string, r int, c int")
    got = {}
    for x in graph.fill_basin(frame(spark, grids), basin).collect():
        got.setdefault(int(x.grid_id), set()).add((x.r, x.c, x.d))
    for g, m in enumerate(grids):
        assert got.get(g, set()) == naive_fill(m, basins[g]), g


def test_inspect_counts_cycles(spark, ways):
    m = [[1, 2, 0], [4, 3, 3], [1, 1, 1]]
    x = graph.inspect(frame(spark, [m]), dims(spark, [m]), spark.createDataFrame([("0", 2, 2)], "grid_id string, r int, c int")).first()
    assert (x.active, x.cycle_cells, x.connected, x.unreachable, x.outlets) == (8, 4, 3, 5, 1)


def test_outlet_ranking(spark):
    m = [[1, 1, 1, 1], [0, 0, 0, 0], [1, 1, 0, 0]]
    got = [(x.r, x.c, x.cells) for x in graph.rank_outlets(frame(spark, [m])).orderBy("place").collect()]
    assert got == [(0, 3, 4), (2, 1, 2)]


def test_components(spark, ways):
    m = [[1, 0, 1], [0, 1, 0], [1, 1, 0]]
    cells = frame(spark, [m])
    four = {(x.r, x.c): x.component for x in graph.components(cells).collect()}
    assert four == {(0, 0): 0, (0, 2): 1, (1, 1): 2, (2, 0): 2, (2, 1): 2}
    assert {x.component for x in graph.components(cells, diagonal=True).collect()} == {0}


def test_loop_repair_reaches_outlet(spark):
    m = [[0, 0, 0], [1, 2, 0], [4, 3, 0]]
    done = correction.correct(frame(spark, [m]), spark.createDataFrame([("0", 1, 2)], "grid_id string, r int, c int")).collect()
    assert {x.state for x in done} <= {"kept", "edited"}
    assert 0 < sum(x.state == "edited" for x in done) < 4


def test_kept_when_connected(spark):
    m = [[1, 1, 1], [4, 0, 0], [4, 3, 3]]
    done = correction.correct(frame(spark, [m]), spark.createDataFrame([("0", 0, 2)], "grid_id string, r int, c int")).collect()
    assert {x.state for x in done} == {"kept"}


def test_empty_grid(spark, ways):
    none = spark.createDataFrame([], "grid_id string, r int, c int, d int")
    assert graph.trace(none).count() == 0
    assert graph.flowlines(none).count() == 0
    assert graph.components(none).count() == 0


def brute_states(before, after, outlets):
    """State of each cell of a repaired grid, by following its flow."""
    states = {}
    for at in after:
        here, seen = at, set()
        while here in after and here not in outlets and here not in seen:
            seen.add(here)
            dr, dc = {1: (0, 1), 2: (1, 0), 3: (0, -1), 4: (-1, 0)}[after[here]]
            here = (here[0] + dr, here[1] + dc)
        states[at] = "unresolved" if here not in outlets else "kept" if after[at] == before.get(at, 0) else "edited"
    return states


def test_repair_queries_take_whole_grids(spark, tmp_path):
    from catchment.plans import fixtures, registry

    rng = random.Random(8)
    rows = [(g, 40 + r, 50 + c, rng.randrange(40), 1, float(rng.randrange(1, 9))) for g, share in (("A", 1.0), ("B", 0.7)) for r in range(40) for c in range(50) if rng.random() < share]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = {g: {(p - 40, s - 50): (o + n) % 4 + 1 for f, p, s, o, n, _ in rows if f == g} for g in "AB"}
    spots = [(7, 9), (20, 31), (39, 49), (12, 3)]
    cells = fixtures.cells(spark, str(tmp_path), 4).persist()
    done = correction.correct(cells, spark.createDataFrame([(g, 7, 9) for g in "AB"], "grid_id string, r int, c int")).collect()
    stops = spark.createDataFrame([(g, r, c, 100 * r + c) for g in "AB" for r, c in spots], "grid_id string, r int, c int, label int")
    parts = correction.correct_by_outlet(cells, graph.partition_by_outlet(cells, stops), stops).collect()
    for name, out, outlets in (("connect_outlet", done, {(7, 9)}), ("connect_outlets", parts, set(spots))):
        got = Counter(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
        assert got == Counter(map(tuple, out)) and not any(x.state == "unresolved" and x.grid_id == "A" for x in out)
        for g in "AB":
            after = {(x.r, x.c): x.d for x in out if x.grid_id == g}
            assert after.keys() >= before[g].keys() and len(after) == sum(x.grid_id == g for x in out)
            states = brute_states(before[g], after, outlets)
            assert states == {(x.r, x.c): x.state for x in out if x.grid_id == g}


def test_connected_cells_are_kept_up_to_date():
    """The mask that repair carries on equals a search from the outlet."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        d = rng.integers(0, 5, (7, 8))
        grid = correction.Grid(d, d > 0, np.zeros(d.shape, bool), np.zeros(d.shape, bool), (3, 4))
        assert np.array_equal(grid.repair(), grid.reached())


def test_cheapest_path_matches_relaxation():
    rng = np.random.default_rng(5)
    for _ in range(40):
        d, goals = rng.integers(0, 5, (5, 6)), rng.random((5, 6)) < 0.1
        head = rng.random((5, 6)) < 0.2
        grid = correction.Grid(d, d > 0, head, correction._grow(head), (4, 5))
        cells = [(r, c, used) for r in range(5) for c in range(6) for used in (0, 1)]
        best, changed = {(0, 0, 0): 0}, True
        while changed:
            changed = False
            for r, c, used in cells:
                for (dr, dc), code in correction.CODE.items():
                    to = (r + dr, c + dc)
                    if (r, c, used) in best and grid.inside(*to):
                        more = int(not (grid.route[to] or to == grid.outlet))
                        price = best[r, c, used] + 100 * correction.edit_cost(d[r, c], code, head[r, c], grid.halo[r, c]) + 1 + 1000 * more
                        if used + more <= 1 and price < best.get((*to, used + more), 1 << 60):
                            best[(*to, used + more)], changed = price, True
        path = grid.cheapest((0, 0), goals)
        want = min((v for (r, c, _), v in best.items() if goals[r, c]), default=None)
        assert (path is None) == (want is None)
        if path:
            steps = zip(path, path[1:])
            assert want == sum(100 * correction.edit_cost(d[a], correction.CODE[b[0] - a[0], b[1] - a[1]], head[a], grid.halo[a]) + 1 + 1000 * (not (grid.route[b] or b == grid.outlet)) for a, b in steps)


def carried(spark, drawing, seeds):
    """Codes after propagation on a drawing (# line), seeds (r, c) -> code."""
    cells = spark.createDataFrame([("g", r, c, d) for (r, c), d in seeds.items()], "grid_id string, r int, c int, d int")
    line = spark.createDataFrame([("g", r, c) for r, row in enumerate(drawing) for c, k in enumerate(row) if k == "#"], "grid_id string, r int, c int")
    return {(x.r, x.c): (x.d, round(x.conf, 2)) for x in correction.propagate(cells, line).collect()}


def test_directions_follow_lines(spark):
    # on and back along a straight line, round a corner, up to its end
    assert carried(spark, ["#####", "    #"], {(0, 2): 1}) == {(0, 0): (1, 0.52), (0, 1): (1, 0.52), (0, 3): (1, 0.52), (0, 4): (2, 0.52), (1, 4): (2, 0.52)}
    # two ways on that fit alike are a branch: the walk ends before it, with its last step's code
    assert carried(spark, ["   # ", "#### ", "   # "], {(1, 0): 1}) == {(1, 1): (1, 0.52), (1, 2): (1, 0.52), (1, 3): (1, 0.52)}
    # seeds that face each other propose nothing; seeds in a row agree
    assert carried(spark, ["#####"], {(0, 0): 1, (0, 4): 3}) == {}
    assert carried(spark, ["#####"], {(0, 0): 1, (0, 4): 1}) == {(0, c): (1, 0.6) for c in (1, 2, 3)}
    # a line that starts across a seed's axis isn't its own
    assert carried(spark, ["#", "#", "#"], {(1, 0): 1}) == {}
